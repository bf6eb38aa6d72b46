"""Components, trees and neighbourhoods as DataFrame iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; in local mode without either a new
    local folder, set on the context. On a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Written to and read back from the shared folder, so that plans stay short and lost executors
    cost a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each connected component. Each round points every
    node at the smallest of its neighbours' labels and then at its label's label, so chains halve."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = cut(both.unionAll(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        nxt = cut(step.join(up, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "was"))
        moved = nxt.where("label <> was").limit(1).count()
        labels = nxt.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def tree_paths(nodes: DataFrame, node: str, parent: str, order: str, max_depth: int = 100) -> DataFrame:
    """(node, depth, path): depth and sort path of every node below a root (a node without a parent
    in the table), level by level. Cycles are never reached from a root; levels end at max_depth."""
    n = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.format_string("%012d", F.col(order).cast("long")).alias("__o"))
    known = n.select(F.col("node").alias("parent")).distinct().withColumn("there", F.lit(True))
    level = cut(n.join(known, "parent", "left").where("there is null").select("node", F.lit(0).alias("depth"), F.col("__o").alias("path")))
    out, depth = level, 0
    while depth < max_depth:
        depth += 1
        level = cut(n.join(level.select(F.col("node").alias("parent"), F.col("path").alias("up")), "parent").select("node", F.lit(depth).alias("depth"), F.concat_ws("/", "up", "__o").alias("path")))
        if level.isEmpty():
            break
        out = out.unionAll(level)
    return out


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within so many undirected steps of the seeds (column node), with the
    least number of steps."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        step = both.join(reached.where(F.col("hop") == h - 1), F.col("src") == F.col("node")).select(F.col("dst").alias("node"), F.lit(h).alias("hop"))
        reached = cut(reached.unionAll(step).groupBy("node").agg(F.min("hop").alias("hop")))
    return reached


def upsert_ranked(current: DataFrame, incoming: DataFrame, key: str, rank: str, order: str) -> DataFrame:
    """Of current and incoming rows the one with the highest rank; of equals the current one, then
    the earliest: a weak assertion never replaces a strong one."""
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    best = F.min_by(F.struct(*current.columns), F.struct(-F.col(rank), "__new", order))
    return both.groupBy(key).agg(best.alias("row")).select("row.*")


def descendants(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, root, hops): all nodes below each node, by joining closures of twice the length until
    none is new; cycles end as pairs are kept once, with their least number of hops."""
    base = cut(edges.select(F.col(parent).alias("root"), F.col(child).alias("node"), F.lit(1).alias("hops")).where("root is not null and node is not null").distinct())
    reach, known = base, base.count()
    while True:
        far = reach.alias("a").join(reach.alias("b"), F.col("a.node") == F.col("b.root")).select("a.root", "b.node", (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        reach = cut(reach.unionAll(far).groupBy("root", "node").agg(F.min("hops").alias("hops")))
        if (now := reach.count()) == known:
            return reach.select("node", "root", "hops")
        known = now


def relation_audit(relations: DataFrame, nodes: DataFrame, key: str, src: str, dst: str, rank: str) -> DataFrame:
    """Adds verdict: missing_endpoint if one end is no node, weaker if the same ends have a relation of
    a higher rank, else valid."""
    ids = nodes.select("node").distinct()
    best = relations.groupBy(src, dst).agg(F.max(rank).alias("__best"))
    r = relations.join(ids.select(F.col("node").alias(src), F.lit(True).alias("__s")), src, "left").join(ids.select(F.col("node").alias(dst), F.lit(True).alias("__d")), dst, "left").join(best, [src, dst])
    return r.select(key, src, dst, rank, F.when(F.col("__s").isNull() | F.col("__d").isNull(), "missing_endpoint").when(F.col(rank) < F.col("__best"), "weaker").otherwise("valid").alias("verdict"))
