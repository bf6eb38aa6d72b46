"""Folds without SQL against plain loops: seen keys, blocks under headings, differences of blocks."""

from __future__ import annotations

import random

from lodestone.operators import dedup, sequence


def test_seen_keys(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), rng.choice([None, "", *"pqrstuv"]), rng.choice([None, "", *"ijklmn"]), "x") for k in range(80)]
    rng.shuffle(rows)
    expected = set()
    for group in "ab":
        seen = set()
        for r in sorted(r for r in rows if r[1] == group):
            keys = {(c, v) for c, v in zip("de", r[2:4], strict=True) if v}
            if not keys & seen:
                seen |= keys
                expected.add(r)
    df = spark.createDataFrame(rows, "k int, g string, d string, e string, kind string")
    assert set(map(tuple, dedup.seen_fold(df, ["d", "e"], "k", "g").collect())) == expected
    assert dedup.seen_fold(df.limit(0), ["d", "e"], "k", "g").count() == 0


def test_blocks_under_headings(spark):
    text = "intro\n# A\n\none\n## B\n- item\n### C\nx\n## D\ny\n# E\n* z"
    df = spark.createDataFrame([("k", text), ("n", None), ("e", "")], "key string, text string")
    got = [(r.block, r.path, r.kind, r.chars) for r in sequence.segments(df, "key", "text").orderBy("block").collect()]
    assert got == [
        (0, "", "text", 5), (1, "A", "heading", 3), (2, "A", "text", 3), (3, "A > B", "heading", 4), (4, "A > B", "list", 6), (5, "A > B > C", "heading", 5), (6, "A > B > C", "text", 1), (7, "A > D", "heading", 4),
        (8, "A > D", "text", 1), (9, "E", "heading", 3), (10, "E", "list", 3),
    ]


def test_differences_of_blocks(spark):
    long = "a block of several words that stays nearly the same"
    df = spark.createDataFrame([(1, f"one\n{long}\nthree", f"one\n{long} now\nnew"), (2, None, "x\ny"), (3, "x  y", "x y"), (4, "a\nb", None), (5, None, None)], "k int, a string, b string")
    got = {tuple(r) for r in sequence.block_diff(df, "k", "a", "b").collect()}
    assert got == {(1, 1, 1, 1, 1), (2, 0, 2, 0, 0), (3, 1, 0, 0, 0), (4, 0, 0, 2, 0), (5, 0, 0, 0, 0)}


def test_unlike_blocks_are_not_compared_letter_by_letter(spark, monkeypatch):
    """Blocks that share too few characters are told apart by counting them."""
    asked, whole = [], sequence.difflib.SequenceMatcher
    monkeypatch.setattr(sequence.difflib, "SequenceMatcher", lambda *a, **k: asked.append(a) or whole(*a, **k))
    pairs = [("abc " * 9, "xyz " * 9), ("short", "a much longer block"), ("some words", "some word"), ("", ""), ("ab" * 8, "ba" * 8), ("abcd", "dcba")]
    assert [sequence._near(x, y, 0.8) for x, y in pairs] == [whole(None, x, y).ratio() >= 0.8 for x, y in pairs]
    assert len(asked) == 3  # the last two have the same characters; of the last one few stand in the same order
