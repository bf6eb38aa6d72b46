"""Distinct and de-duplication operators. `order` names the column that stands for file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def richest(df: DataFrame, key: str, richness: Column, order: str, collect: str) -> DataFrame:
    """One row per key: the richest (the first of equals), with the sorted set of `collect` over
    all of the key's rows. One aggregation with map-side combine; no window holds a key's rows."""
    best = F.min_by(F.struct(*df.columns), F.struct(-richness, F.col(order)))
    return df.groupBy(key).agg(best.alias("row"), F.sort_array(F.collect_set(collect)).alias("collected")).select("row.*", F.col("collected").alias(f"{collect}s"))


def duplicate_pointer(df: DataFrame, identity: Column, path: str) -> DataFrame:
    """Adds duplicate_of: the smallest path with the same identity, null for that row itself and
    for rows without identity."""
    d = df.withColumn("identity", identity)
    first = d.where(F.col("identity").isNotNull()).groupBy("identity").agg(F.min(path).alias("first_path"))
    return d.join(first, "identity", "left").withColumn("duplicate_of", F.when(F.col("first_path") != F.col(path), F.col("first_path"))).drop("first_path")


def latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key by `order`, as one aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order)).alias("row")).select(*keys, "row.*")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the keys (one after another, not as one OR condition) with `seen`.
    A null key matches nothing."""
    for k in keys:
        df = df.join(seen.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti").select(df.columns)
    return df


def merged_facts(df: DataFrame, key: str, order: str, flag: str, sources: str) -> DataFrame:
    """Repeated facts as one: the first row's values, whether any is flagged, the set of sources."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c not in (key, flag, sources))), order).alias("row"), F.bool_or(flag).alias(flag), F.sort_array(F.collect_set(sources)).alias(sources)).select(key, "row.*", flag, sources)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Violations of uniqueness: keys with their number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def by_type_quota(df: DataFrame, kind: str, quota: dict[str, int], *order: Column | str) -> DataFrame:
    """The first rows of each type, as many as its quota allows."""
    limit = F.coalesce(*(F.when(F.col(kind) == k, F.lit(n)) for k, n in quota.items()), F.lit(0))
    w = Window.partitionBy(kind).orderBy(*order)
    most = max(quota.values(), default=0)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).where(F.col("place") <= limit)


def seen_fold(df: DataFrame, keys: list[str], order: str, group: str) -> DataFrame:
    """The order-dependent filter: within each group rows in order, a row goes if any of its keys was
    seen, and only kept rows add theirs. Runs in rounds: of the undecided rows those that are first
    for all of their keys are kept, and the others that share a key with a kept row go; the first
    undecided row of a group is always decided, so this ends, and no task holds a group. Orders must
    be unique within a group. Null and blank keys match nothing."""
    from lodestone.operators.graph import cut

    said = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys))
    long = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.explode(said).alias("k")).select("g", "o", "k.kind", "k.value").where("value is not null and value <> ''")
    keyless = df.select(F.col(group).alias("g"), F.col(order).alias("o")).join(long.select("g", "o").distinct(), ["g", "o"], "left_anti")
    open_, kept = cut(long), cut(keyless)
    while not open_.isEmpty():
        first = open_.groupBy("g", "kind", "value").agg(F.min("o").alias("first"))
        told = open_.join(first, ["g", "kind", "value"])
        now = cut(told.groupBy("g", "o").agg(F.bool_and(F.col("o") == F.col("first")).alias("wins")).where("wins").select("g", "o"))
        taken = open_.join(now, ["g", "o"], "left_semi").select("g", "kind", "value").distinct()
        gone = open_.join(taken, ["g", "kind", "value"], "left_semi").select("g", "o").distinct()
        open_ = cut(open_.join(gone, ["g", "o"], "left_anti"))
        kept = kept.unionAll(now)
    return df.join(kept.select(F.col("g").alias(group), F.col("o").alias(order)), [group, order], "left_semi").select(df.columns)


def duplicate_titles(df: DataFrame, doi: str, title: str, order: str) -> DataFrame:
    """One row per DOI, or without one per title of which only letters and digits count; the first stays."""
    key = F.coalesce(F.concat(F.lit("doi:"), F.nullif(F.lower(F.trim(doi)), F.lit(""))), F.concat(F.lit("title:"), F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", "")))
    return df.groupBy(key.alias("key")).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("key", "r.*")
