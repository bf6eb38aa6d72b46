"""Tables that cut lineage: written to the shared checkpoint folder and read back."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Arrow batches that Python tasks get while a table is settled: small ones, as several workers share
#: an executor's memory.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. If it is unset, the context's checkpoint folder; if that is
    unset too and Spark runs in local mode (tests, local use), a new local folder, which is set on the
    context so that later calls share it. On a cluster an unset folder is an error, as executors could
    not read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` as Parquet into the shared folder and return it as read back. A lost executor
    then costs a re-read, not a recomputation. Shuffle files of what came before can go once
    nothing refers to them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of settled tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_settled", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks of this session get small Arrow batches from now on."""
    spark.conf.set(_BATCH, BATCH_BYTES)


def tidy(spark: SparkSession, times: int = 2) -> None:
    """Let Spark's cleaner notice shuffles whose frames are gone, so that their files do not stay on
    disk beside those of the next steps."""
    for _ in range(times):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: rows (node, comp), comp the smallest node that
    can be reached. Alternates the large-star and small-star steps of Kiveris et al. ("Connected
    components in MapReduce and beyond"), each step one shuffle over the edges; a hub's
    neighbours are never gathered, only a minimum per node is aggregated and joined back."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = settle(pairs, "cc")
    state = cur.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        nxt = settle(small, "cc")
        now = nxt.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        drop(cur)
        cur = nxt
        if now == state:
            break
        state = now
    comp = cur.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return comp.unionByName(roots)



def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver's. What reads one is about to run Python over whole texts, so batches are
    made small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
