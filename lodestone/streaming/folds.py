"""Incremental forms of the ledger folds with Structured Streaming. Each runs until what is there has
been read (AvailableNow) and may be run again; a batch that is replayed gives the same state, as every
state version is named by the batch that made it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.sinks import append_events, delete, exists


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Feed all that is there to `each`, batch by batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def _state(spark: SparkSession, folder: str, batch: int, schema) -> DataFrame:
    path = f"{folder}/state-{batch}"
    return spark.read.schema(schema).parquet(path) if batch >= 0 and exists(spark, path) else spark.createDataFrame([], schema)


def changes(stream: DataFrame, folder: str, key: str, print_: str) -> DataFrame:
    """Each batch's items against the state, which is the batch before only: (batch, key, event) with
    new, updated or seen. An item that was away returns as new. Keys are unique within a batch."""
    spark = stream.sparkSession
    schema = stream.select(key, print_).schema

    def each(batch: DataFrame, k: int) -> None:
        now = batch.select(key, print_)
        was = _state(spark, folder, k - 1, schema).withColumnRenamed(print_, "__was")
        event = F.when(F.col("__was").isNull(), "new").when(F.col("__was") == F.col(print_), "seen").otherwise("updated")
        now.join(was, key, "left").select(F.lit(k).alias("batch"), key, event.alias("event")).write.mode("overwrite").parquet(f"{folder}/events/batch={k}")
        now.write.mode("overwrite").parquet(f"{folder}/state-{k}")

    run(stream, f"{folder}/checkpoint", each)
    return spark.read.parquet(f"{folder}/events").select("batch", key, "event")


def event_sink(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """An append-only ledger in which each key is once, however often its event arrives."""
    run(stream, f"{folder}/checkpoint", lambda batch, k: append_events(batch, f"{folder}/ledger", key))
    return stream.sparkSession.read.parquet(f"{folder}/ledger")


def assembled(stream: DataFrame, folder: str, key: str, at: str, phase: str, ident: str, start: str, ends: list[str], gap: str = "1 hour") -> DataFrame:
    """Requests from their phases: per key and window of time the phases in order, if it has a start and
    an end not before it; phases before the start are dropped. The state of a window is its phases."""
    spark = stream.sparkSession
    grouped = stream.groupBy(key, F.window(at, gap)["start"].alias("window")).agg(F.collect_set(F.struct(F.col(at).alias("at"), F.col(ident).alias("id"), F.col(phase).alias("phase"))).alias("p"))

    def each(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/{k}")
        for old in [b for b in whole_batches(spark, f"{folder}/windows") if b < k - 1]:
            delete(spark, f"{folder}/windows/{old}")

    run(grouped, f"{folder}/checkpoint", each, "complete")
    return request_rows(spark.read.parquet(f"{folder}/windows/{max(whole_batches(spark, f'{folder}/windows'))}"), key, start, ends)


def whole_batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches below a folder that were written to their end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(s.getPath().suffix("/_SUCCESS"))]


def request_rows(windows: DataFrame, key: str, start: str, ends: list[str]) -> DataFrame:
    """(key, window, phases, last_phase, first_id) of the windows (key, window, p) that are complete."""
    ordered = F.array_sort("p")
    w = windows.select(key, "window", ordered.alias("p"))
    begin = F.array_min(F.filter("p", lambda x: x["phase"] == start))
    w = w.withColumn("begin", begin).where("begin is not null").withColumn("p", F.filter("p", lambda x: x >= F.col("begin")))
    w = w.withColumn("stop", F.array_min(F.filter("p", lambda x: x["phase"].isin(*ends)))).where("stop is not null")
    return w.select(key, "window", F.size(F.filter("p", lambda x: x <= F.col("stop"))).alias("phases"), F.col("stop.phase").alias("last_phase"), F.col("begin.id").alias("first_id"))


def set_changes(stream: DataFrame, folder: str, key: str, member: str) -> DataFrame:
    """Per batch and key what its set of members adds to, and lacks of, the set of the batch in which the
    key was seen last: (batch, key, added, removed)."""
    spark = stream.sparkSession
    sets = lambda d: d.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("members"))
    schema = sets(stream).schema

    def each(batch: DataFrame, k: int) -> None:
        now, was = sets(batch), _state(spark, folder, k - 1, schema).withColumnRenamed("members", "was")
        both = now.join(was, key, "full_outer")
        empty = F.array().cast(schema["members"].dataType)
        before = F.coalesce("was", empty)
        both.where("members is not null").select(F.lit(k).alias("batch"), key, F.array_except("members", before).alias("added"), F.array_except(before, "members").alias("removed")).write.mode("overwrite").parquet(f"{folder}/changes/batch={k}")
        both.select(key, F.coalesce("members", "was").alias("members")).write.mode("overwrite").parquet(f"{folder}/state-{k}")

    run(stream, f"{folder}/checkpoint", each)
    return spark.read.parquet(f"{folder}/changes").select("batch", key, "added", "removed")
