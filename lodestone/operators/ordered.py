"""Folds over ordered rows that start anew: batches of bounded size, line blocks, paragraphs.

Where a block begins decides where the next one begins, so a plain loop reads a document from its start.
Here each row first learns how far its block would reach if one began with it (`reach`, at most `most`
rows, from a frame of that many rows). Documents are cut into segments; following the reaches from each
of a segment's first `most` rows gives where each of them leaves it. One row a segment then tells in
which row each segment is entered, and all segments mark their own blocks. No task reads a document
longer than a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import cut

SEGMENT = 4096


def positions(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds __i, the row's 0-based place in its group by `order`. Rows are sorted by range over all
    tasks; a range's rows follow those of the ranges before it. Rows that are equal in `order` keep some
    order, the same for whatever reads the result. Names that begin with two underscores are for these operators."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, low = F.monotonically_increasing_id(), (1 << 33) - 1
    rows = df.withColumn("__row", at).repartitionByRange(n, group, *order, "__row").sortWithinPartitions(group, *order, "__row").drop("__row")
    rows = cut(rows.select("*", F.spark_partition_id().alias("__part"), at.bitwiseAND(low).alias("__at")))
    ranges = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a task
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(ranges.select("__part", before.alias("__before"))), "__part").withColumn("__g", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
    first = rows.groupBy(F.col(group).alias("__group")).agg(F.min("__g").alias("__first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn("__i", F.col("__g") - F.col("__first")).drop("__group", "__first", "__g")


def _name(group: str) -> Column:
    """A group's value as text, also if it is null."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("~"))


def with_reach(placed: DataFrame, group: str, reach: Callable[[Window], Column], most: int, segment: int = SEGMENT) -> DataFrame:
    """Adds __seg and __reach. `reach(frame)` is a column over a frame of the row and the `most` rows
    after it. Each segment also gets the rows that follow it, so that frames never leave a segment's task."""
    seg = F.floor(F.col("__i") / segment)
    copies = F.when((F.col("__i") % segment < most) & (seg > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))
    rows = placed.withColumn("__seg", F.explode(copies))
    frame = Window.partitionBy(group, "__seg").orderBy("__i").rowsBetween(0, most)
    return rows.withColumn("__reach", reach(frame).cast("long")).where(F.col("__i") >= F.col("__seg") * segment).where(F.col("__i") < (F.col("__seg") + 1) * segment)


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut so that rows of equal keys stay together: a batch's last key waits."""
    held = None
    for b in frames:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if b.empty:
            continue
        last = b[keys].iloc[-1]
        same = np.ones(len(b), dtype=bool)
        for k in keys:
            same &= (b[k] == last[k]).to_numpy() if pd.notna(last[k]) else b[k].isna().to_numpy()
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start:
            yield b.iloc[:start].reset_index(drop=True)
        held = b.iloc[start:].reset_index(drop=True)
    if held is not None and not held.empty:
        yield held


def _bounds(b: pd.DataFrame) -> np.ndarray:
    """Where segments begin and end in sorted rows: each has rows of following places."""
    at, seg = b["__i"].to_numpy(), b["__seg"].to_numpy()
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(seg) != 0)) + 1
    return np.concatenate([[0], new, [len(b)]])


def _leaving(most: int):
    """For each of a segment's first rows: the row of the next segment that is entered, and how many
    blocks begin on the way."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _runs(frames, ["__group", "__seg"]):
            rows, bounds, reach = [], _bounds(b), b["__reach"].to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                n = hi - lo
                exits, begun = np.zeros(n + most, dtype=np.int64), np.zeros(n + most, dtype=np.int64)
                exits[n:] = np.arange(most)
                for k in range(n - 1, -1, -1):
                    nxt = k + int(reach[lo + k])
                    exits[k], begun[k] = exits[nxt], begun[nxt] + 1
                rows.append((b["__group"].iloc[lo], b["__seg"].iloc[lo], exits[:most].tolist(), begun[:most].tolist()))
            yield pd.DataFrame(rows, columns=["__group", "__seg", "exits", "begun"])

    return run


def _entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of segments: the row in which each is entered, and the blocks begun before."""
    group, entry, before = None, 0, 0
    for b in frames:
        rows = []
        for g, seg, exits, begun in zip(b["__group"], b["__seg"], b["exits"], b["begun"], strict=True):
            if seg == 0:
                group, entry, before = g, 0, 0
            rows.append((g, seg, entry, before))
            entry, before = int(exits[entry]), before + int(begun[entry])
        yield pd.DataFrame(rows, columns=["__group", "__seg", "__entry", "__before"])


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _runs(frames, ["__group", "__seg"]):
        bounds, reach = _bounds(b), b["__reach"].to_numpy()
        block = np.zeros(len(b), dtype=np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            k, number = lo + int(b["__entry"].iloc[lo]), int(b["__before"].iloc[lo]) - 1
            block[lo : min(k, hi)] = number
            while k < hi:
                number += 1
                nxt = k + int(reach[k])
                block[k : min(nxt, hi)] = number
                k = nxt
        yield pd.DataFrame({"__group": b["__group"], "__i": b["__i"], "__block": block})


def blocks(placed: DataFrame, group: str, reach: Callable[[Window], Column], most: int, block: str = "block", segment: int = SEGMENT) -> DataFrame:
    """`placed` (from `positions`) with the 0-based number of the block in which each row is. Null groups
    are a group."""
    spark = placed.sparkSession
    if segment < most:
        raise ValueError("a segment holds a block at least")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_reach(placed, group, reach, most, segment)
    steps = cut(rows.select(_name(group).alias("__group"), "__seg", "__i", "__reach"))
    many = steps.where("__seg > 0").select("__group").distinct()
    ordered = steps.join(many, "__group", "left_semi").repartition(n, "__group", "__seg").sortWithinPartitions("__group", "__seg", "__i")
    leaving = cut(ordered.mapInPandas(_leaving(most), "__group string, __seg long, exits array<long>, begun array<long>"))
    entered = leaving.repartition(n, "__group").sortWithinPartitions("__group", "__seg").mapInPandas(_entered, "__group string, __seg long, __entry long, __before long")
    known = steps.join(entered, ["__group", "__seg"], "left").fillna(0, ["__entry", "__before"])
    marked = known.repartition(n, "__group", "__seg").sortWithinPartitions("__group", "__seg", "__i").mapInPandas(_marked, "__group string, __i long, __block long")
    # as many rows as `placed`, but of steps that take few bytes on disk: by these Spark would broadcast them
    out = placed.withColumn("__group", _name(group)).join(marked.hint("merge"), ["__group", "__i"])
    return out.withColumnRenamed("__block", block).drop("__group")


def bounded_batches(df: DataFrame, group: str, order: list[str], size: Column, most_items: int = 40, most_size: int = 8000, segment: int = SEGMENT) -> DataFrame:
    """Adds `batch`: items in order, a new batch where the current one has `most_items` or would exceed
    `most_size`. An item that is larger alone is a batch of its own. Null sizes count as 0."""
    placed = positions(df.withColumn("__size", F.coalesce(size, F.lit(0)).cast("long")), group, order)

    def reach(frame):
        sizes = F.collect_list("__size").over(frame)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open"))

        def step(s, x):
            fits = s["open"] & (s["n"] < most_items) & ((s["n"] == 0) | (s["sum"] + x <= most_size))
            return F.struct((s["n"] + fits.cast("int")).alias("n"), (s["sum"] + x).alias("sum"), fits.alias("open"))

        return F.aggregate(sizes, start, step)["n"]

    return blocks(placed, group, reach, most_items, "batch", segment).drop("__size", "__i")


def line_blocks(lines: DataFrame, group: str, kind: str, left: str, top: str, right: str, bottom: str, text: str, page_width: str, most: dict[str, int] | None = None, other: int = 18, segment: int = SEGMENT) -> DataFrame:
    """Adds `block`: the lines of a group by vertical centre, then horizontal. A block ends where it has
    its most lines (by `kind`), at a wide gap, at a smaller gap with a shift of indent against the block's
    first line, and, but in titles, before what looks like a heading. `kind` and `page_width` are the
    same for all lines of a group. The median of a group's line heights sets the limits."""
    most = {"title": 6} if most is None else most
    widest = max([other, *most.values()])
    height = F.greatest(F.lit(1.0), F.col(bottom) - F.col(top))
    rows = lines.withColumns({"__h": height, "__cy": (F.col(top) + F.col(bottom)) / 2, "__cx": (F.col(left) + F.col(right)) / 2})
    medians = rows.groupBy(F.col(group).alias("__mg")).agg(F.expr("percentile(__h, 0.5)").alias("__med"))
    rows = rows.join(medians, F.col(group).eqNullSafe(F.col("__mg"))).drop("__mg")
    placed = positions(rows, group, ["__cy", "__cx"])
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    number = lambda n: F.regexp_replace(F.left(t, F.lit(n)), r"\.+$", "").rlike(r"^[0-9]+$")
    heading = (F.length(t) <= 90) & (number(2) | number(3) | ((F.col("__h") > F.col("__med") * 1.25) & (F.greatest(F.lit(1.0), F.col(right) - F.col(left)) < F.col(page_width) * 0.45)))
    limit = F.lit(other)
    for k, n in most.items():
        limit = F.when(F.col(kind) == k, n).otherwise(limit)
    line = F.struct(F.col(left).alias("x"), F.col(top).alias("y"), F.col(bottom).alias("b"), heading.alias("head"))

    def reach(frame):
        rows, med, own = F.collect_list(line).over(frame), F.col("__med"), F.col("__limit")
        first = F.element_at(rows, 1)["x"]

        def starts(x, k):
            before = F.get(rows, k - 1)
            gap = x["y"] - before["b"]
            shifted = F.abs(x["x"] - first) > F.greatest(F.lit(32.0), med * 1.2)
            return (k > 0) & ((k >= own) | (gap > F.greatest(F.lit(42.0), med * 2.2)) | ((gap > med * 0.75) & shifted) | (~F.col("__title") & x["head"] & (gap > med * 0.35)))

        at = F.array_position(F.transform(rows, starts), True) - 1
        return F.when(at > 0, at).otherwise(F.least(F.size(rows), own))

    placed = placed.withColumns({"__limit": limit, "__title": F.coalesce(F.col(kind) == "title", F.lit(False))})
    return blocks(placed, group, reach, widest, "block", segment).drop("__h", "__cy", "__cx", "__med", "__limit", "__title", "__i")


def paragraphs(lines: DataFrame, group: str, order: list[str], top: str, bottom: str, text: str) -> DataFrame:
    """(group, paragraph, lines, text): lines joined until a gap of more than 1.85 median heights (10 at
    least) or a line that looks like a list item. A hyphen at a line's end goes when the next line is
    joined to it. Lines without text are left out. Here the gap alone decides, so a running sum will do."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    rows = lines.withColumns({"__h": F.greatest(F.lit(1.0), F.col(bottom) - F.col(top)), "__text": t})
    limit = rows.groupBy(F.col(group).alias("__mg")).agg((F.greatest(F.lit(10.0), F.expr("percentile(__h, 0.5)") * 1.85)).alias("__limit"))
    rows = rows.where("__text <> ''").join(limit, F.col(group).eqNullSafe(F.col("__mg"))).drop("__mg")
    placed = positions(rows, group, order)
    listed = F.trim(F.left("__text", F.lit(2))).isin("-", "*") | F.regexp_replace(F.left("__text", F.lit(3)), r"\.+$", "").rlike("^[0-9]+$")

    def reach(frame):
        after = F.collect_list(F.struct(F.col(top).alias("y"), F.col(bottom).alias("b"), listed.alias("item"))).over(frame)
        ends = (F.size(after) < 2) | F.get(after, F.lit(1))["item"] | (F.get(after, F.lit(1))["y"] - F.get(after, F.lit(0))["b"] > F.col("__limit"))
        return F.when(ends, 1).otherwise(0)

    ended = with_reach(placed, group, reach, 1)
    # the number of a line's paragraph: the ends before it, from one row a segment and a sum inside it
    totals = ended.groupBy(group, "__seg").agg(F.sum("__reach").alias("__n"))
    w = Window.partitionBy(group).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("__tg"), F.col("__seg").alias("__ts"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(group, "__seg").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ended.withColumn("__inside", F.coalesce(F.sum("__reach").over(inside), F.lit(0)))
    numbered = numbered.join(totals, F.col(group).eqNullSafe(F.col("__tg")) & (F.col("__seg") == F.col("__ts"))).withColumn("paragraph", F.col("__base") + F.col("__inside"))
    said = numbered.groupBy(group, "paragraph").agg(F.array_sort(F.collect_list(F.struct("__i", "__text"))).alias("__said"))
    joined = F.aggregate("__said", F.lit(""), lambda a, x: F.when(a == "", x["__text"]).when(a.endswith("-"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), x["__text"])).otherwise(F.concat(a, F.lit(" "), x["__text"])))
    return said.select(group, "paragraph", F.size("__said").alias("lines"), joined.alias("text"))
