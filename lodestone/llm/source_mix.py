"""Mixing sources to target weights by entropy balancing.

Each source gets a target of tokens: its weight's share of all sizes, at most `most` times its own size,
where what it cannot take goes to the others by weight until no target is above. The rates r of a
source's documents are those of largest entropy, sum(r - r log r), with sum(r * size) = target and
r <= most. Their convex dual has one multiplier a source, and r = min(most, exp(multiplier * size / mean
size)). All multipliers are found together by Newton steps on the dual, each step one aggregation; a
step that leaves the bracket of signs is replaced by a bisection.

Documents of a source and size have the same rate, so the steps run over (source, size, number) alone.
The rates become whole copies from the largest size to the smallest, handing on the tokens that rounding
took too many or too few. Which of a size's documents get one copy more than the others is settled by
hashes of their id and text; sizes with many documents are dealt to buckets by that hash, and buckets
take their extra copies in turn, so that no group is ranked in one task.

The only group that one task reads in order is the list of a source's sizes: n different sizes need
n * n / 2 tokens at least, so there are few, and they are streamed, not held.

Defined results: a null text has size 0 and a null source is a source of its own, after the others; a
document of size 0 is not taken (0 tokens whatever its copies); rows that repeat an id are documents of
their own; the same rows give the same mix; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import drop, parts, settle

WORD = r"[^\x20\x09-\x0D]+"
#: The most copies of a document; the error of a source's tokens at which its multiplier is settled,
#: relative to the target (or a thousandth of a token), and the most steps; the documents of one bucket.
MOST, ERROR, STEPS, BUCKET = 3, 1e-7, 100, 512
#: Sums of this kind do not depend on the order of their rows, so that reruns agree.
EXACT = "decimal(38,9)"


def sized(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(id, source, size, h): narrow rows; `h` orders the documents of a source and size."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))
    return docs.select(F.col(id_col).alias("id"), name.alias("source"), size.alias("size"), F.xxhash64(id_col, F.xxhash64(text)).alias("h"))


def ranked(names: DataFrame, column: str, rank: str) -> DataFrame:
    """Adds the 0-based rank of `column`, whose values differ. Ranges of values are sorted apart, and
    each range starts after the rows of those before it."""
    spark = names.sparkSession
    at = F.monotonically_increasing_id()
    rows = names.repartitionByRange(parts(spark), column).sortWithinPartitions(column).select("*", F.spark_partition_id().alias("__part"), at.bitwiseAND((1 << 33) - 1).alias("__at"))
    rows = settle(rows, "ranks")
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("__part", before.alias("__before")), "__part").withColumn(rank, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int = MOST) -> DataFrame:
    """(source, total, target) from (source, total). Whole numbers give the level, so that equal input
    gives equal bits. Each round holds at their ceiling the sources above the level; the level only
    rises, so they stay there."""
    rank = (F.col("rank") % len(weights) + 1).cast("int")
    rows = settle(ranked(sources, "source", "rank").select("source", "total", F.element_at(F.array(*map(F.lit, weights)), rank).alias("weight")), "weights")
    all_sizes, level, held = rows.agg(F.sum("total")).first()[0] or 0, 0.0, -1
    ceiling = F.col("total") * most
    while True:
        above = F.col("weight") * F.lit(level) >= ceiling if held >= 0 else F.lit(False)
        n, taken, weight = rows.agg(F.sum(above.cast("long")), F.sum(F.when(above, ceiling)), F.sum(F.when(~above, F.col("weight")))).first()
        if n is None or n == held or not weight:
            break
        held, level = n, (all_sizes - (taken or 0)) / weight
    made = F.least(F.col("weight") * F.lit(level), ceiling.cast("double"))
    return rows.select("source", "total", made.alias("target"))


def multipliers(sizes: DataFrame, goals: DataFrame, most: int = MOST, error: float = ERROR, steps: int = STEPS) -> DataFrame:
    """(source, multiplier, mean) by Newton steps; the multiplier is null where the target is the
    ceiling and every rate `most`. `sizes` has source, size and n, `goals` source, total and target."""
    counts = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    state = goals.join(counts, "source").where("total > 0").select("source", "target", (F.col("total") / F.col("n")).alias("mean"), F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("settled"), (F.col("target") >= F.col("total") * most).alias("full"))
    state = settle(state, "dual")
    sizes = sizes.where("size > 0")
    for _ in range(steps):
        open_ = state.where("not settled and not full")
        x = F.col("size") / F.col("mean")
        z = F.col("m") * x
        tilt = F.exp(F.least(z, F.lit(log(most))))
        slope = F.when(z < log(most), tilt * x).otherwise(0.0)
        sums = sizes.join(open_, "source").groupBy("source").agg(*(F.sum((F.col("n") * F.col("size") * c).cast(EXACT)).cast("double").alias(k) for k, c in (("got", tilt), ("slope", slope))))
        rows = state.join(sums, "source", "left")
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("m")).otherwise(F.col("lo")), F.when(off > 0, F.col("m")).otherwise(F.col("hi"))
        newton = F.col("m") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        halved = F.when(lo.isNull(), hi * 2 - 1).when(hi.isNull(), lo * 2 + 1).otherwise((lo + hi) / 2)
        done = F.abs(off) <= F.col("target") * error + 0.001
        rows = rows.select("source", "target", "mean", F.when(off.isNull() | done, F.col("m")).when(inside, newton).otherwise(halved).alias("m"), lo.alias("lo"), hi.alias("hi"), F.coalesce(done, F.col("settled")).alias("settled"), "full")
        after = settle(rows, "dual")
        drop(state)
        state = after
        if not state.where("not settled and not full").take(1):
            break
    return state.select("source", F.when(~F.col("full"), F.col("m")).alias("multiplier"), "mean")


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Copies of each size in place of its rate, from the largest size of a source to the smallest."""
    last, carried = None, 0.0
    for batch in batches:
        copies = []
        for source, size, n, rate in zip(*(batch.column(c).to_pylist() for c in ("source", "size", "n", "rate")), strict=True):
            if source != last:
                last, carried = source, 0.0
            if not size:
                copies.append(0)
                continue
            wanted = rate * n * size + carried
            taken = min(most * n, max(0, int(wanted / size + 0.5)))
            carried = wanted - taken * size
            copies.append(taken)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source", "size", "n")), pa.array(copies, pa.int64())], ["source", "size", "n", "copies"])


def copies(sizes: DataFrame, tilts: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, copies): the copies that a size's n documents have in all."""
    rate = F.when(F.col("multiplier").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size") / F.col("mean"))))
    rows = sizes.join(tilts, "source", "left").select("source", "size", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    rows = rows.repartition(parts(sizes.sparkSession), "source").sortWithinPartitions("source", F.desc("size"))
    return rows.mapInArrow(lambda batches: _whole(batches, most), "source string, size long, n long, copies long")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for each row of `docs`; taken = copies * size."""
    rows = settle(sized(docs, id_col, text, source), "sized")
    sizes = settle(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    goals = settle(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), weights, most), "goals")
    whole = copies(sizes, multipliers(sizes, goals, most), most).join(goals, "source")
    whole = settle(whole.select("source", "size", "n", "total", "target", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("extra")), "copies")

    dealt = rows.join(whole, ["source", "size"]).withColumn("bucket", F.when(F.col("extra") > 0, F.pmod(F.col("h"), F.floor(F.col("n") / bucket) + 1)))
    even = dealt.where("extra = 0").withColumn("more", F.lit(0))
    uneven = dealt.where("extra > 0")
    key = ["source", "size", "bucket"]
    held = uneven.groupBy(*key).agg(F.count("*").alias("held"), F.first("extra").alias("all_extra"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*key, (F.col("all_extra") - before).alias("quota"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("h", "id"))
    uneven = uneven.join(held, key).withColumn("more", (place <= F.col("quota")).cast("int")).drop("quota")
    made = even.unionByName(uneven).withColumn("copies", F.col("each") + F.col("more"))
    return made.select(F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
