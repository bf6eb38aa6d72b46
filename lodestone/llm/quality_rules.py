"""Quality rules as a learned decision list.

Statistics of whole texts (counts of words, symbols, repeated lines and windows, and so on) are
taken in one pass. A list of rules is learned from labelled documents by sequential covering: a
rule, a conjunction of thresholds on ratios of these counts, grows condition by condition on one
part of the labelled rows, is pruned from its end on the other part, and is kept if it rejects
almost no good document there; the rows it covers are set aside and the next one is grown. The
list is one Spark expression, `when(rule 1, ..).when(rule 2, ..)..otherwise(keep)`.

Null and empty texts have zero counts. Labels that are null are left out; of several labels for a
document the lowest counts. Without labels of both kinds no rule is learned and the list keeps
everything. Rows with repeated ids are judged each by itself. Other columns are ignored by the
statistics, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.textkit import Words, mix, words_of

#: Counted per text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?"
WINDOW = 8
#: At most so many labelled documents are fitted on: those with the smallest hash of their id.
MAX_LABELLED = 20_000


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_CLASSES = {"n_symbols": _table(SYMBOLS), "n_upper": _table(bytes(range(65, 91))), "n_digits": _table(b"0123456789"), "n_marks": _table(MARKS)}
_LETTERLIKE = np.ones(256, dtype=bool)
_LETTERLIKE[0x80:0xC0] = False
_LETTERLIKE[[32, 9, 10, 11, 12, 13]] = False


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(w: Words, width: int = WINDOW) -> np.ndarray:
    """For each text the number of words in windows that occur in it twice or more."""
    n = len(w.doc)
    if n < width:
        return np.zeros(len(w.count), dtype=np.int64)
    h = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0x100000001B3) + w.hash[k : n - width + 1 + k]
    at = np.flatnonzero(w.doc[: n - width + 1] == w.doc[width - 1 :])
    key = mix(h[at]) + mix(w.doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, dtype=np.int64)
    hit = at[twice]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    return _per_text(np.cumsum(step[:-1]) > 0, w.first)


def _line_counts(data: bytes, bounds: np.ndarray) -> tuple[list[int], list[int]]:
    lines, dup = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        full = [x for x in data[a:b].split(b"\n") if x and not x.isspace()]
        lines.append(len(full))
        dup.append(len(full) - len(set(full)))
    return lines, dup


def _counts(texts: pa.Array) -> list[pa.Array]:
    cols: dict[str, list] = {c: [] for c in COUNTS}
    for _, w in words_of(texts, lower=False):
        lines, dup = _line_counts(w.data.tobytes(), w.bounds)
        cols["n_words"].append(w.count)
        cols["word_chars"].append(_per_text(_LETTERLIKE[w.data], w.bounds))
        for c, table in _CLASSES.items():
            cols[c].append(_per_text(table[w.data], w.bounds))
        cols["n_repeat_words"].append(repeated_words(w))
        cols["n_lines"].append(lines)
        cols["n_dup_lines"].append(dup)
    return [pa.array(np.concatenate(cols[c]) if cols[c] else [], pa.int64()) for c in COUNTS]


def statistics(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: its id and COUNTS (long), over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_counts(b.column(1))], names=[id_col, *COUNTS])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def with_counts(df: DataFrame, text: str, into: str) -> DataFrame:
    """`df` with the counts of each row's text as the struct column `into`."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(_counts(b.column(at)), list(COUNTS))], names=[*b.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))]))


#: Ratios that rules set thresholds on: (numerator, denominator or None).
RATIOS = {"words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "words_a_line": ("n_words", "n_lines")}


def ratio(name: str, at: str = "") -> Column:
    """The ratio from columns of COUNTS, or from the fields of a struct if `at` is its name and a dot."""
    top, bottom = RATIOS[name]
    return F.col(at + top).cast("double") if bottom is None else F.coalesce(F.try_divide(F.col(at + top).cast("double"), F.col(at + bottom)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction: (ratio, "<=" or ">", threshold) for each condition."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, op, t in self.conditions:
            out &= x[name] <= t if op == "<=" else x[name] > t
        return out

    def column(self, at: str = "") -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            out = out & (ratio(name, at) <= t if op == "<=" else ratio(name, at) > t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {t:.6g}" for n, op, t in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def kept(self, at: str = "") -> Column:
        """The list as an ordered conditional expression over COUNTS: false for a row that a rule
        rejects, else true."""
        out = None
        for r in self.rules:
            out = F.when(r.column(at), F.lit(False)) if out is None else out.when(r.column(at), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def reason(self) -> Column:
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(str(r))) if out is None else out.when(r.column(), F.lit(str(r)))
        return F.lit(None).cast("string") if out is None else out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, max_rules: int = 12, max_conditions: int = 4, cuts: int = 64) -> DecisionList:
    """Sequential covering over rows with ratios `x`; `bad` marks those to reject."""
    n = len(bad)
    fold = np.arange(n) % 3
    grow_all, prune_all = fold != 2, fold == 2
    left = np.ones(n, dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & grow_all, left & prune_all
        rule = _pruned(_grown(x, bad, grow, max_conditions, cuts), x, bad, prune)
        if rule is None:
            break
        hit = rule.covers(x)
        p, q = (hit & prune & bad).sum(), (hit & prune & ~bad).sum()
        wrong = (hit & left & ~bad).sum() / max(1, (hit & left).sum())
        if p < 3 or p / (p + q) < precision or wrong > 1 - precision:
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(rules)


def _grown(x, bad, rows, max_conditions, cuts) -> Rule:
    """Add the threshold with the largest information gain until no good row is covered."""
    conditions: list[tuple[str, str, float]] = []
    inside = rows.copy()
    while len(conditions) < max_conditions:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p0 == 0 or n0 == 0:
            break
        base, best = np.log2(p0 / (p0 + n0)), None
        for name, values in x.items():
            v = values[inside]
            distinct = np.unique(v)
            if len(distinct) < 2:
                continue
            mids = (distinct[1:] + distinct[:-1]) / 2
            if len(mids) > cuts:
                q = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)), np.quantile(v[bad[inside]], np.linspace(0, 1, cuts))]))
                mids = mids[np.unique(np.clip(np.searchsorted(mids, q), 0, len(mids) - 1))]
            y = bad[inside]
            order = np.argsort(v, kind="stable")
            pos = np.concatenate([[0], np.cumsum(y[order])])
            k = np.searchsorted(v[order], mids, side="right")
            for op, p, m in (("<=", pos[k], k), (">", p0 - pos[k], len(v) - k)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(m, 1)) - base), -1.0)
                j = int(np.argmax(gain))
                if gain[j] > 1e-9 and (best is None or gain[j] > best[0]):
                    best = (float(gain[j]), (name, op, float(mids[j])))
        if best is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(conditions))


def _pruned(rule: Rule, x, bad, rows) -> Rule | None:
    """Of the rule and its shorter beginnings, the one with the best (p - n) / (p + n)."""
    best = None
    for k in range(len(rule.conditions), 0, -1):
        cut = Rule(rule.conditions[:k])
        hit = cut.covers(x) & rows
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth > best[0] or (worth == best[0] and p > best[2]):
            best = (worth, cut, p)
    return best[1] if best else None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, **options) -> DecisionList:
    """Learn the list from the documents that have a label; 0 means to reject. The labelled rows
    are bounded by `max_labelled`; those that fail the base rules are judged without the list and
    left out. Of rows that repeat a labelled id the least by its ratios counts."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("__label")).orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    few = docs.select(id_col, text).join(F.broadcast(chosen), id_col, "left_semi")
    rows = statistics(few, id_col, text).join(F.broadcast(chosen), id_col).where(~base_failed()).select(id_col, "__label", *(ratio(r).alias(f"__{r}") for r in RATIOS))
    rows = rows.groupBy(id_col).agg(F.min(F.struct(*(f"__{r}" for r in RATIOS))).alias("__x"), F.min("__label").alias("__label"), F.min(F.xxhash64(id_col)).alias("__order")).select(id_col, "__label", "__order", "__x.*").toPandas()
    if rows[id_col].dtype.kind in "iu":
        rows["__order"] = mix(rows[id_col].to_numpy().astype(np.int64).view(np.uint64))
    rows = rows.sort_values(["__order", id_col], kind="stable")
    bad = rows["__label"].to_numpy() == 0
    if not bad.any() or bad.all():
        return DecisionList()
    # in the order of a hash of the id, so that the folds do not depend on how ids are dealt out
    return learn({r: rows[f"__{r}"].to_numpy(dtype=float) for r in RATIOS}, bad, **options)


def base_failed(min_words: int = 20, repeat_percent: int = 30, at: str = "") -> Column:
    return (F.col(at + "n_words") < min_words) | (100 * F.col(at + "n_repeat_words") > repeat_percent * F.col(at + "n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The id, COUNTS, base_failed, kept (false if base_failed, else the list's verdict) and the
    rule that rejected the document, if one did."""
    rules = fit(docs, labels, id_col, text, **options)
    return statistics(docs, id_col, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept()).withColumn("rule", F.when(~F.col("base_failed"), rules.reason()))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, that neither the base rules nor the list reject."""
    rules = fit(docs, labels, id_col, text, **options)
    into = "__counts"
    while into in docs.columns:
        into += "_"
    return with_counts(docs, text, into).where(~base_failed(at=f"{into}.") & rules.kept(f"{into}.")).select(docs.columns)
