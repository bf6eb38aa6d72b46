"""What a run hands on: public items in reading order, candidates for review, compact items, manifests of
sources, the run's health, the briefing as Markdown, and batches of rows for table uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators.ordered import positions

# Fixed values.
PUBLIC = [
    "item_id", "source_id", "source_kind", "title", "url", "published_at", "summary", "authors", "tags", "event_type", "provenance", "topic_relevance", "method_novelty_hint", "reading_tier",
    "freshness_gate", "llm_triage",
]
TIERS = {"must_read": "Priority", "skim": "Scan", "collapsed": "Hold", "archive": "Archive"}
LOADED = ["ok", "ok_no_updates"]
ANGLE = "Explain what changed, why it matters, and what remains uncertain."
NOTICE = "Reading tiers are configurable attention hints, not scientific-quality grades."
CLOSING = "Generated from `daily_items.jsonl`; verify consequential claims against the original source."


def public_items(items: DataFrame) -> DataFrame:
    """The public fields in their order and nothing else; those the items lack are null."""
    return items.select(*(F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in PUBLIC))


def tier_rank(tier: Column) -> Column:
    """0 for what is to be read first; 99 for tiers that are not known, and null."""
    rank = F.lit(99)
    for k, name in reversed(list(enumerate(TIERS))):
        rank = F.when(tier == name, k).otherwise(rank)
    return rank


def reading_order() -> list[Column]:
    """Tier, relevance from the highest (null: 0), date (null first), lower-case title, and the id."""
    return [tier_rank(F.col("reading_tier")), F.desc(F.coalesce("topic_relevance", F.lit(0.0))), fx.compact("published_at"), F.lower(fx.compact("title")), F.col("item_id")]


def content_candidates(items: DataFrame, as_of: str) -> DataFrame:
    """Items of the two upper tiers as candidates that a person must review."""
    return items.where(F.col("reading_tier").isin("must_read", "skim")).select(
        F.concat(F.lit("content:"), "item_id").alias("candidate_id"), F.col("item_id").alias("source_item_id"), F.col("url").alias("source_url"), "title", F.lit(ANGLE).alias("angle_hint"),
        F.lit("researchers_and_builders").alias("audience"), F.lit("needs_human_review").alias("status"), F.lit(as_of).alias("as_of"),
    )


def compact_items(items: DataFrame) -> DataFrame:
    """Items cut to what a triage reads: 300 characters of title and 900 of summary."""
    return items.select(
        fx.compact("item_id").alias("item_id"), F.left(fx.compact("title"), F.lit(300)).alias("title"), F.left(fx.compact("summary"), F.lit(900)).alias("summary"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), fx.compact("reading_tier").alias("deterministic_tier"), "topic_relevance",
    )


def source_manifests(sources: DataFrame, loaded: DataFrame, run_at: str) -> DataFrame:
    """A row for each configured source (source_id, source_kind, enabled, required, role, status, error),
    with the number of rows it loaded (rows of `loaded` by source_id). Flags that are null are false, a
    role that is null or blank is supplemental."""
    n = loaded.groupBy("source_id").agg(F.count("*").alias("item_count"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    role = F.when(fx.compact("role") == "", "supplemental").otherwise(fx.compact("role"))
    return sources.join(n, "source_id", "left").select(
        "source_id", fx.compact("source_kind").alias("source_kind"), flag("enabled"), flag("required"), role.alias("role"), "status", F.coalesce("item_count", F.lit(0)).alias("item_count"), fx.compact("error").alias("error"), F.lit(run_at).alias("generated_at"),
    )


def run_health(manifests: DataFrame) -> DataFrame:
    """(daily_status, source_count, loaded_source_count) in one row. Enabled sources count. All required
    ones failed: failed; some: degraded; else warnings, which are partial sources and optional ones that
    failed: complete_with_warning; else complete if a required one loaded, or none is required; else
    degraded. Without required sources the day fails if all failed. `loaded` counts disabled sources too."""
    on, bad, need = F.coalesce("enabled", F.lit(False)), F.coalesce(F.col("status").isin("failed", "missing"), F.lit(False)), F.coalesce("required", F.lit(False))
    warned = F.coalesce(F.col("status").isin("partial", "warning"), F.lit(False)) | (~need & bad)
    counts = {"sources": on, "needed": on & need, "broken": on & need & bad, "fine": on & need & F.coalesce(F.col("status").isin(LOADED), F.lit(False)), "warnings": on & warned, "down": on & bad, "loaded": F.coalesce(F.col("status").isin(LOADED), F.lit(False))}
    c = manifests.agg(*(F.count_if(x).alias(f"__{k}") for k, x in counts.items()))
    v = {k: F.col(f"__{k}") for k in counts}
    warn = F.when(v["warnings"] > 0, "complete_with_warning")
    none_needed = F.when((v["sources"] > 0) & (v["down"] == v["sources"]), "failed").otherwise(F.coalesce(warn, F.lit("complete")))
    needed = F.when(v["broken"] == v["needed"], "failed").when(v["broken"] > 0, "degraded").otherwise(F.coalesce(warn, F.when(v["fine"] > 0, "complete").otherwise("degraded")))
    return c.select(F.when(v["needed"] == 0, none_needed).otherwise(needed).alias("daily_status"), v["sources"].alias("source_count"), v["loaded"].alias("loaded_source_count"))


def number(x: Column) -> Column:
    """A score of at most four decimals as text: 0.25, 1.0; None for null."""
    return F.coalesce(F.regexp_replace(x.cast("decimal(18,4)").cast("string"), r"(\.\d+?)0*$", "$1"), F.lit("None"))


def markdown(items: DataFrame, health: DataFrame, as_of: str, title: str = "Brief") -> DataFrame:
    """(part, block): the briefing's blocks, to be written in the order of `part`, each followed by a new
    line: a head with the run's health, for each tier a heading with its number of items and the items
    in reading order, or that there are none, and a closing. Items of other tiers are counted in the head only."""
    spark = items.sparkSession
    tiers = spark.createDataFrame([(k, n, label) for k, (n, label) in enumerate(TIERS.items())], "rank int, reading_tier string, label string")
    sizes = items.groupBy("reading_tier").agg(F.count("*").alias("n"))
    part = lambda rank, place=None: F.struct(F.lit(rank).cast("int").alias("rank") if isinstance(rank, int) else rank.cast("int").alias("rank"), *(place or _nothing()))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    said = F.format_string(f"# {title} · {as_of}\n\n> Daily status: **%s** · sources %d/%d · items %d\n\n{NOTICE}\n", "daily_status", "loaded_source_count", "source_count", "total")
    one = F.lit(1).alias("__one")
    head = health.select("*", one).join(total.select("*", one), "__one").select(part(-1).alias("part"), said.alias("block"))  # one row each
    counted = tiers.join(sizes, "reading_tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    heading = F.concat(F.format_string("## %s · %d\n", "label", "n"), F.when(F.col("n") == 0, "\nNo items.\n").otherwise(""))
    headings = counted.select(part(F.col("rank")).alias("part"), heading.alias("block"))
    name, url, day, summary = (fx.compact(c) for c in ("title", "url", "published_at", "summary"))
    filled = lambda x, other: F.when(x == "", other).otherwise(x)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    block = F.concat(
        F.lit("### "), F.when(url == "", name).otherwise(F.concat(F.lit("["), name, F.lit("]("), url, F.lit(")"))), F.lit("\n\n- Source: `"), fx.compact("source_id"), F.lit("` · published `"), filled(day, "undated"), F.lit("` · freshness `"), plain("freshness_gate"),
        F.lit("`\n- Topic relevance: `"), number(F.col("topic_relevance")), F.lit("` · novelty hint: `"), number(F.col("method_novelty_hint")), F.lit("`\n- Event: `"), plain("event_type"), F.lit("` · identity: `"), plain("item_id"), F.lit("`\n\n"), filled(summary, "No summary supplied by the source."), F.lit("\n"),
    )
    place = [F.lit(1).alias("kind"), (-F.coalesce("topic_relevance", F.lit(0.0))).alias("score"), day.alias("day"), F.lower(name).alias("name"), F.coalesce("item_id", F.lit("")).alias("id")]
    rows = items.where(F.col("reading_tier").isin(list(TIERS))).select(part(tier_rank(F.col("reading_tier")), place).alias("part"), block.alias("block"))
    closing = spark.range(1).select(part(100).alias("part"), F.lit(f"---\n\n{CLOSING}").alias("block"))
    return head.unionByName(headings).unionByName(rows).unionByName(closing)


def _nothing() -> list[Column]:
    return [F.lit(0).alias("kind"), F.lit(0.0).alias("score"), F.lit("").alias("day"), F.lit("").alias("name"), F.lit("").alias("id")]


def write_markdown(blocks: DataFrame, path: str) -> None:
    """The blocks as text files whose names sort in the order of the briefing."""
    blocks.orderBy("part").select("block").write.mode("overwrite").text(path)


def batch_payloads(rows: DataFrame, order: list[str], fields: list[str], size: int) -> DataFrame:
    """(batch, payload): the rows in batches of `size`, each as one JSON object of the field names and the
    rows' values as lists, in order. Fields that the rows lack are null; all values are texts."""
    placed = positions(rows.withColumn("__all", F.lit(1)), "__all", order)
    values = F.array(*(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string") for c in fields))
    b = placed.groupBy(F.floor(F.col("__i") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("__i", values.alias("v")))).alias("r"))
    return b.select("batch", F.to_json(F.struct(F.array(*map(F.lit, fields)).alias("fields"), F.transform("r", lambda x: x["v"]).alias("rows"))).alias("payload"))
