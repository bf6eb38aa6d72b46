"""Queries of what a run hands on. Documents stand for items, suppliers for sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import briefing
from lodestone.operators.ordered import positions
from lodestone.plans.catalogue import PUBLISHED_SQL, TEXT, _norm, published, query, table

_TIERS = ["must_read", "skim", "collapsed", "archive", "unknown"]
_ITEMS_SQL = f"""SELECT doc_id, 'd' || doc_id AS item_id, source, left(t, 40) AS title, CASE WHEN doc_id % 3 > 0 THEN 'https://x.example/' || doc_id ELSE '' END AS url, coalesce(strftime({PUBLISHED_SQL}, '%Y-%m-%d'), '') AS day, t AS summary,
 (doc_id % 8)::DECIMAL(9, 4) / 4 AS relevance, ['must_read', 'skim', 'collapsed', 'archive', 'unknown'][1 + doc_id % 5] AS tier FROM (SELECT *, {TEXT} AS t FROM documents)"""


def _items(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents"))
    k = F.col("doc_id")
    return d.select(
        "doc_id", F.concat(F.lit("d"), k).alias("item_id"), F.col("source").alias("source_id"), F.left("norm", F.lit(40)).alias("title"), F.when(k % 3 > 0, F.concat(F.lit("https://x.example/"), k)).alias("url"), F.date_format(published(), "yyyy-MM-dd").alias("published_at"), F.col("norm").alias("summary"),
        F.lit("new").alias("event_type"), (k % 8 / 4).alias("topic_relevance"), F.lit(0.5).alias("method_novelty_hint"), F.get(F.array(*map(F.lit, _TIERS)), (k % 5).cast("int")).alias("reading_tier"), F.lit("fresh").alias("freshness_gate"), F.array(F.col("lang")).alias("tags"),
    )


@query(f"""WITH i AS ({_ITEMS_SQL}), b AS (
 SELECT ['must_read', 'skim', 'collapsed', 'archive'].list_position(tier) - 1 AS tier, item_id AS item, '### ' || CASE WHEN url = '' THEN trim(title) ELSE '[' || trim(title) || '](' || url || ')' END || chr(10) || chr(10) || '- Source: `' || source || '` · published `' || CASE WHEN day = '' THEN 'undated' ELSE day END || '` · freshness `fresh`' || chr(10)
  || '- Topic relevance: `' || ['0.0', '0.25', '0.5', '0.75', '1.0', '1.25', '1.5', '1.75'][1 + doc_id % 8] || '` · novelty hint: `0.5`' || chr(10) || '- Event: `new` · identity: `' || item_id || '`' || chr(10) || chr(10) || CASE WHEN summary = '' THEN 'No summary supplied by the source.' ELSE summary END || chr(10) AS block FROM i WHERE tier <> 'unknown'
 UNION ALL SELECT k, '', '## ' || label || ' · ' || n || chr(10) || CASE WHEN n = 0 THEN chr(10) || 'No items.' || chr(10) ELSE '' END FROM (SELECT k, label, count(item_id) AS n FROM (VALUES (0, 'must_read', 'Priority'), (1, 'skim', 'Scan'), (2, 'collapsed', 'Hold'), (3, 'archive', 'Archive')) v (k, t, label) LEFT JOIN i ON tier = t GROUP BY k, label)
 UNION ALL SELECT -1, '', '# Brief · 2024-06-30' || chr(10) || chr(10) || '> Daily status: **complete** · sources ' || (SELECT count(*) FROM supplier) || '/' || (SELECT count(*) FROM supplier) || ' · items ' || (SELECT count(*) FROM i) || chr(10) || chr(10) || '{briefing.NOTICE}' || chr(10)
 UNION ALL SELECT 100, '', '---' || chr(10) || chr(10) || '{briefing.CLOSING}')
SELECT tier::INTEGER AS tier, item, block FROM b""")
def briefing_markdown(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit(True).alias("enabled"), F.lit(True).alias("required"), F.lit("ok").alias("status"))
    blocks = briefing.markdown(_items(spark, sf_dir), briefing.run_health(s), "2024-06-30")
    return blocks.select(F.col("part.rank").alias("tier"), F.col("part.id").alias("item"), "block")


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT item_id, row_number() OVER (ORDER BY list_position(['must_read', 'skim', 'collapsed', 'archive', 'unknown'], tier), relevance DESC, day, encode(lower(trim(title))), item_id)::BIGINT AS place FROM i")
def reading_order(spark, sf_dir):
    """Each item's place among all, without one task that sorts them all."""
    i = briefing.public_items(_items(spark, sf_dir)).select("item_id", briefing.tier_rank(F.col("reading_tier")).alias("r"), (-F.col("topic_relevance")).alias("s"), F.coalesce("published_at", F.lit("")).alias("d"), F.lower(F.trim("title")).alias("n"), F.lit(1).alias("one"))
    return positions(i, "one", ["r", "s", "d", "n", "item_id"]).select("item_id", (F.col("__i") + 1).alias("place"))


@query(f"WITH i AS ({_ITEMS_SQL}) SELECT 'content:' || item_id AS candidate_id, nullif(url, '') AS source_url, left(trim(title), 300) AS title, left(summary, 900) AS summary, tier AS deterministic_tier FROM i WHERE tier IN ('must_read', 'skim')")
def review_candidates(spark, sf_dir):
    i = _items(spark, sf_dir)
    c, short = briefing.content_candidates(i, "2024-06-30"), briefing.compact_items(i)
    return c.join(short.select(F.col("item_id").alias("source_item_id"), F.col("title").alias("t"), "summary", "deterministic_tier"), "source_item_id").select("candidate_id", "source_url", F.col("t").alias("title"), "summary", "deterministic_tier")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)
SELECT (k // 500)::BIGINT AS batch, '{"fields":["o_orderkey","note","o_custkey"],"rows":[' || string_agg('["' || o_orderkey || '",null,"' || o_custkey || '"]', ',' ORDER BY k) || ']}' AS payload FROM n GROUP BY 1""")
def table_payloads(spark, sf_dir):
    return briefing.batch_payloads(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], ["o_orderkey", "note", "o_custkey"], 500)


@query("SELECT s_name AS source_id, 'nation ' || s_nationkey AS source_kind, s_suppkey % 2 = 0 AS enabled, false AS required, CASE WHEN s_suppkey % 3 = 0 THEN 'main' ELSE 'supplemental' END AS role, 'ok' AS status, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS item_count, '' AS error, 't' AS generated_at FROM supplier")
def source_manifests(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    sources = s.select(F.col("s_name").alias("source_id"), F.concat(F.lit("nation  "), "s_nationkey").alias("source_kind"), (k % 2 == 0).alias("enabled"), F.lit(None).cast("boolean").alias("required"), F.when(k % 3 == 0, "main").alias("role"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    loaded = table(spark, sf_dir, "lineitem").join(s.select(k.alias("l_suppkey"), F.col("s_name").alias("source_id")), "l_suppkey").select("source_id")
    return briefing.source_manifests(sources, loaded, "t")
