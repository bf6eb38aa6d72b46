"""Per-document sequence operators without a relational form: diffs and segmentation. Each row is a
document of its own, so tasks hold one document at a time and nothing is grouped."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _blocks(text: str | None) -> list[str]:
    return [b.strip() for b in re.split(r"\n+", text or "") if b.strip()]


def _common(x: str, y: str) -> int:
    """The length of the longest common subsequence, whose table has a bit for each character of x."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    row = whole = (1 << len(x)) - 1
    for c in y:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(x) - row.bit_count()


def _near(x: str, y: str, alike: float) -> bool:
    """Whether SequenceMatcher's ratio is `alike` at least. What it matches is no longer than the shorter
    text, than the characters that both have, and than their longest common subsequence; these bounds are
    much cheaper than the ratio and mostly decide."""
    n = len(x) + len(y)
    few = lambda m: 2.0 * m / n < alike
    if n and (few(min(len(x), len(y))) or few((Counter(x) & Counter(y)).total()) or few(_common(x, y))):
        return False
    return difflib.SequenceMatcher(None, x, y).ratio() >= alike


def block_diff(df: DataFrame, key: str, before: str, after: str, alike: float = 0.8) -> DataFrame:
    """(key, same, added, removed, reworded): blocks matched by content hash in order; a replaced
    block counts as reworded if its text is at least `alike` like the block it replaces."""

    def one(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
        ha, hb = ([hashlib.sha256(re.sub(r"\s+", " ", x).encode()).digest() for x in y] for y in (a, b))
        same = added = removed = reworded = 0
        for tag, i, j, k, l in difflib.SequenceMatcher(None, ha, hb, autojunk=False).get_opcodes():
            if tag == "equal":
                same += j - i
                continue
            near = sum(_near(x, y, alike) for x, y in zip(a[i:j], b[k:l], strict=False))
            reworded += near
            removed += j - i - near
            added += l - k - near
        return same, added, removed, reworded

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [one(_blocks(a), _blocks(b)) for a, b in zip(pdf[before], pdf[after], strict=True)]
            out = pd.DataFrame(rows, columns=["same", "added", "removed", "reworded"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, before, after).mapInPandas(run, f"{key} {kind}, same long, added long, removed long, reworded long")


_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, path, kind, chars): the blocks of Markdown texts with the stack of headings that
    stands above each of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                stack: list[tuple[int, str]] = []
                for n, block in enumerate(_blocks(t)):
                    m = _HEADING.match(block)
                    if m:
                        stack = [s for s in stack if s[0] < len(m[1])] + [(len(m[1]), m[2])]
                    rows.append((k, n, " > ".join(s[1] for s in stack), "heading" if m else ("list" if block[:2] in ("- ", "* ") else "text"), len(block)))
            yield pd.DataFrame(rows, columns=[key, "block", "path", "kind", "chars"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, block long, path string, kind string, chars long")
