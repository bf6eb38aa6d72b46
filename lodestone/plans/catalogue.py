"""Every registered query outside the optional subpackage, with its SQL.

Each query binds an operator of this library to the driver's tables; column meanings differ from
those of curation records, the computation is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as fx
from lodestone.operators import dedup, graph, joins, report, sequence

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "item_curation"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: The same text without control characters and with single spaces, in DuckDB's regular expressions.
NORM = r"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), '[\s\p{{Z}}\x{{85}}\x0b]+', ' ', 'g'))"
TEXT = NORM.format(c="text")
TERMS = {"the": 0.3, "and": 0.2, "der": 0.35, "que": 0.3}
PENALTIES = {"spam": 0.5, "|": 0.2}
NOW = "2024-06-30"


def _norm(d: DataFrame) -> DataFrame:
    return d.withColumn("norm", fx.compact("text"))


def _score_sql(c: str, source: str) -> str:
    parts = [f"CASE WHEN contains({c}, '{t}') THEN {w}::DOUBLE ELSE 0 END" for t, w in sorted(TERMS.items())]
    less = [f"CASE WHEN contains({c}, '{t}') THEN {w}::DOUBLE ELSE 0 END" for t, w in sorted(PENALTIES.items())]
    more = "CASE " + " ".join(f"WHEN {source} = '{k}' THEN {w}::DOUBLE" for k, w in SOURCE_WEIGHTS.items()) + " ELSE 0::DOUBLE END"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {' + '.join(parts)} - {' - '.join(less)} + {more}))"


NOVELTY = ["new", "licen", "de ", "thing"]
SOURCE_WEIGHTS = {"src0": 0.1, "src3": 0.05}


def _count_sql(c: str, terms: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains({c}, '{t}') THEN 1 ELSE 0 END" for t in terms)


#: Documents as items: they were published on one day in three for each id, and one in nine has no date.
PUBLISHED_SQL = "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE DATE '2024-04-01' + (doc_id % 101)::INTEGER END"


@query(f"""
WITH d AS (SELECT doc_id, source, lang, {TEXT} AS norm, {PUBLISHED_SQL} AS day FROM documents),
s AS (SELECT doc_id, lang, left(norm, 60) AS title, sha256(lower(norm)) AS fp, round({_score_sql('lower(norm)', 'source')}, 4) AS score, least(1.0::DOUBLE, ({_count_sql('lower(norm)', NOVELTY)}) * 0.25::DOUBLE) AS novelty,
 CASE WHEN day IS NULL THEN 'undated' WHEN date_diff('day', day, DATE '{NOW}') < -1 THEN 'future' WHEN date_diff('day', day, DATE '{NOW}') <= 45 THEN 'fresh' ELSE 'stale' END AS gate, length(norm) AS rich FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY rich DESC, doc_id) AS rn, count(*) OVER (PARTITION BY fp) AS n FROM s)
SELECT doc_id, title, lang, score, novelty, gate, n AS copies,
  CASE WHEN gate IN ('stale', 'future') THEN 'archive' WHEN score >= 0.62 AND novelty >= 0.40 THEN 'must_read' WHEN score >= 0.30 THEN 'skim' WHEN score >= 0.10 THEN 'collapsed' ELSE 'archive' END AS tier
FROM f WHERE rn = 1""")
def item_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, identify, keep the richest copy, score relevance and novelty, gate by date, tier."""
    d = _norm(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "norm", published().alias("day"))
    low = F.lower("norm")
    gate = fx.freshness(F.col("day"), F.lit(NOW).cast("date"), 45)
    d = d.select("doc_id", "lang", F.left("norm", F.lit(60)).alias("title"), F.sha2(low, 256).alias("fp"), F.round(fx.term_score(low, TERMS, PENALTIES, fx.weight_of(F.col("source"), SOURCE_WEIGHTS)), 4).alias("score"), fx.novelty(low, NOVELTY).alias("novelty"), gate.alias("gate"), F.length("norm").alias("rich"))
    best = d.groupBy("fp").agg(F.min_by(F.struct("doc_id", "title", "lang", "score", "novelty", "gate"), F.struct(-F.col("rich"), "doc_id")).alias("r"), F.count("*").alias("copies"))
    return best.select("r.*", "copies", fx.tier(F.col("r.score"), F.col("r.novelty"), F.col("r.gate")).alias("tier"))


def published() -> Column:
    """The day of PUBLISHED_SQL."""
    return F.when(F.col("doc_id") % 9 == 0, F.lit(None).cast("date")).otherwise(F.date_add(F.lit("2024-04-01").cast("date"), (F.col("doc_id") % 101).cast("int")))


@query(f"SELECT doc_id, sha256('{{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\",\"text\":\"' || md5({TEXT}) || '\"}}') AS fingerprint FROM documents")
def doc_fingerprint(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents"))
    return d.select("doc_id", fx.fingerprint(lang=F.col("lang"), source=F.col("source"), text=F.md5("norm")).alias("fingerprint"))


@query(f"""WITH d AS (SELECT doc_id, sha256({TEXT}) AS identity FROM documents)
SELECT doc_id, identity, CASE WHEN min(doc_id) OVER (PARTITION BY identity) <> doc_id THEN min(doc_id) OVER (PARTITION BY identity) END AS duplicate_of FROM d""")
def duplicate_pointer(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents"))
    return dedup.duplicate_pointer(d, F.sha2("norm", 256), "doc_id").select("doc_id", "identity", "duplicate_of")


@query(f"""WITH d AS (SELECT doc_id, source, lower(left({TEXT}, 80)) AS key, length({TEXT}) AS rich FROM documents)
SELECT key, arg_min(doc_id, rich * -1000000000 + doc_id) AS doc_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM d GROUP BY key""")
def richest_record(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents")).select("doc_id", "source", F.lower(F.left("norm", F.lit(80))).alias("key"), F.length("norm").alias("rich"))
    return dedup.richest(d, "key", F.col("rich"), "doc_id", "source").select("key", "doc_id", F.concat_ws(",", "sources").alias("sources"))


#: Two snapshots of items of two documents each: by its length a document is in the first, the second
#: or both, where it may have got a space at its end in between.
_BEFORE = f"SELECT doc_id - doc_id % 2 AS item, min(md5(text)) AS h, min(md5({TEXT})) AS l FROM documents WHERE length(text) % 3 IN (0, 2) GROUP BY 1"
_AFTER = f"SELECT doc_id - doc_id % 2 AS item, min(md5(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END)) AS h, min(md5({TEXT})) AS l FROM documents WHERE length(text) % 3 IN (1, 2) GROUP BY 1"


@query(f"""WITH p AS ({_BEFORE}), c AS ({_AFTER})
SELECT c.item, CASE WHEN p.item IS NULL THEN 'new' WHEN p.h = c.h THEN 'seen' ELSE 'updated' END AS event FROM c LEFT JOIN p USING (item)""")
def incremental_event_type(spark, sf_dir):
    """The current batch against the one before only: an item that was away returns as new."""
    p, c = _halves(spark, sf_dir)
    both = c.join(p.select("item", F.col("exact").alias("was")), "item", "left")
    return both.select("item", F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("exact"), "seen").otherwise("updated").alias("event"))


def _halves(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents")).select((F.col("doc_id") - F.col("doc_id") % 2).alias("item"), (F.length("text") % 3).alias("k"), "text", F.md5("norm").alias("loose"), (F.col("doc_id") % 5 == 0).alias("spaced"))
    one = lambda rows, text: rows.groupBy("item").agg(F.min(F.md5(text)).alias("exact"), F.min("loose").alias("loose"))
    return one(d.where("k in (0, 2)"), F.col("text")), one(d.where("k in (1, 2)"), F.when(F.col("spaced"), F.concat("text", F.lit(" "))).otherwise(F.col("text")))


@query(f"""WITH p AS ({_BEFORE}), c AS ({_AFTER})
SELECT coalesce(p.item, c.item) AS item, CASE WHEN p.item IS NULL THEN 'added' WHEN c.item IS NULL THEN 'deleted' WHEN p.l <> c.l THEN 'changed' ELSE 'format_only' END AS change
FROM p FULL JOIN c ON p.item = c.item WHERE p.item IS NULL OR c.item IS NULL OR p.l <> c.l OR p.h <> c.h""")
def snapshot_diff(spark, sf_dir):
    p, c = _halves(spark, sf_dir)
    return joins.snapshot_diff(p, c, "item", "exact", "loose")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'undated' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') < -1 THEN 'future'
WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') <= 45 THEN 'fresh' ELSE 'stale' END AS freshness FROM orders""")
def freshness_tier(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.freshness(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"), 45).alias("freshness"))


@query(r"""WITH u AS (SELECT page_id, trim(coalesce(url, '')) AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 1)) AS s, lower(regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2)) AS h,
 regexp_replace(regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3), '/+', '/', 'g') AS p, regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 4) AS q FROM u)
SELECT page_id, CASE WHEN s IN ('http', 'https') AND h <> '' THEN s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || q ELSE '' END AS url, regexp_replace(h, '^www\.', '') AS host FROM p""")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fx.normalise_url("url").alias("url"), fx.hostname("url").alias("host"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s\p{Z}\x{85}\x0b]+', ' ', 'g'))) AS text_chars FROM pages""")
def page_title_text(spark, sf_dir):
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(fx.strip_tags("html")).cast("long").alias("text_chars"))


_BUCKETS = {"digits": "[0-9]", "quoted": "[\"']", "table": r"\|", "article": "(^|[^A-Za-z0-9_])(the|der|la|el)($|[^A-Za-z0-9_])", "licence": "(?i)licen[cs]e"}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS bucket, count(*) FILTER (regexp_matches(text, '{p.replace("'", "''")}')) AS n FROM documents""" for k, p in _BUCKETS.items()))
def bucket_counts(spark, sf_dir):
    return report.bucket_counts(table(spark, sf_dir, "documents"), {k: F.col("text").rlike(p) for k, p in _BUCKETS.items()})


@query("SELECT doc_id, n_chars, lang FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e') ORDER BY n_chars DESC, doc_id LIMIT 20")
def top_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)licen[cs]e")).select("doc_id", "n_chars", "lang").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("""WITH s AS (SELECT p_partkey, lower(p_name) AS h, lower(p_brand || ' ' || p_type) AS r, p_partkey::VARCHAR AS i, p_size FROM part),
t AS (SELECT *, (CASE WHEN i = '1' THEN 100 WHEN starts_with(i, '1') THEN 60 ELSE 0 END) + (CASE WHEN contains(h, '1') THEN 30 ELSE 0 END) + (CASE WHEN contains(r, '1') THEN 5 ELSE 0 END)
 + (CASE WHEN i = 'brand' THEN 100 WHEN starts_with(i, 'brand') THEN 60 ELSE 0 END) + (CASE WHEN contains(h, 'brand') THEN 30 ELSE 0 END) + (CASE WHEN contains(r, 'brand') THEN 5 ELSE 0 END)
 - (CASE WHEN p_size > 40 THEN 10 ELSE 0 END) AS score FROM s WHERE (contains(i, '1') OR contains(h, '1') OR contains(r, '1')) AND (contains(i, 'brand') OR contains(h, 'brand') OR contains(r, 'brand')))
SELECT p_partkey, score FROM t ORDER BY score DESC, p_partkey LIMIT 12""")
def ranked_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return report.ranked_search(p, ["1", "brand"], "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), F.col("p_size") > 40).select("p_partkey", "score")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z]')) AS letters,
len(regexp_extract_all(text, '[A-Za-z]')) * 2 < length(text) AS few_letters FROM documents""")
def cjk_letter_ratio(spark, sf_dir):
    c, l = fx.count_matches("text", "[\\x{3400}-\\x{9fff}]"), fx.count_matches("text", "[A-Za-z]")
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("cjk"), l.alias("letters"), (l * 2 < F.length("text")).alias("few_letters"))


@query("""SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) >= 200) AS usable,
CASE WHEN count(*) FILTER (length(text) >= 200) * 10 >= count(*) * 9 THEN 'usable' WHEN count(*) FILTER (length(text) >= 200) = 0 THEN 'empty' ELSE 'partial' END AS status FROM documents GROUP BY source""")
def text_usability(spark, sf_dir):
    n = F.length("text")
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(n).alias("chars"), F.count_if(n >= 200).alias("usable"))
    return d.withColumn("status", F.when(F.col("usable") * 10 >= F.col("docs") * 9, "usable").when(F.col("usable") == 0, "empty").otherwise("partial"))


@query("""SELECT 'events' AS ledger, event_id AS ordinal, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
UNION ALL SELECT 'orders', o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, role, '' FROM conversations""")
def timeline_union(spark, sf_dir):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("ledger"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("kind"), stamp("ts").alias("at"))
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("ledger"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("kind"), stamp("o_orderdate").alias("at"))
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("ledger"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("role").alias("kind"), F.lit("").alias("at"))
    return report.timeline([e, o, c])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1""")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return dedup.latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS root_role, count(*) FILTER (role = 'assistant') AS replies,
array_to_string(list(role ORDER BY turn), '>') AS roles FROM conversations GROUP BY conv_id""")
def threads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("root_role"), F.count_if(F.col("role") == "assistant").alias("replies"), F.array_join(F.transform(rows, lambda x: x["role"]), ">").alias("roles"))


_MOVES = {"signup": "registered", "purchase": "customer", "error": "failing"}


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'registered' WHEN 'purchase' THEN 'customer' WHEN 'error' THEN 'failing' END AS s, ts, event_id FROM events)
SELECT user_id, coalesce(arg_max(s, (ts, event_id)) FILTER (s IS NOT NULL), 'idle') AS state, count(s)::INTEGER AS moves FROM r GROUP BY user_id""")
def state_fold(spark, sf_dir):
    return report.state_machine(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], _MOVES, "idle")


@query("SELECT event_id, event_type, value FROM events WHERE user_id IN (1, 2, 3) AND event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-10'")
def node_history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(F.col("user_id").isin(1, 2, 3) & F.col("event_type").isin("click", "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))).select("event_id", "event_type", "value")


@query("""SELECT 'needs_you' AS bucket, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n FROM orders
UNION ALL SELECT 'handled', count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') FROM orders
UNION ALL SELECT 'waiting', count(*) FILTER (o_orderstatus = 'P') FROM orders""")
def attention_queue(spark, sf_dir):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return report.bucket_counts(table(spark, sf_dir, "orders"), {"needs_you": (s == "O") & p.isin("1-URGENT", "2-HIGH"), "handled": (s == "F") | (p == "1-URGENT"), "waiting": s == "P"})


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderdate DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE rn = 1""")
def task_rank_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), F.struct(rank, "o_orderpriority", -F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey")).alias("r")).select("o_custkey", "r.*")


@query("""WITH o AS (SELECT o_custkey AS chain, o_orderpriority AS stage, o_orderstatus = 'F' AS done, o_orderstatus = 'P' AS blocked, o_orderstatus = 'O' AND o_totalprice > 300000 AS waiting, date_diff('day', o_orderdate::DATE, DATE '1996-01-10') AS age FROM orders),
n AS (SELECT chain, stage, count(*) FILTER (NOT done) AS active, count(*) FILTER (done) AS done, count(*) FILTER (NOT done AND blocked) AS blocked, count(*) FILTER (NOT done AND waiting) AS waiting, count(*) FILTER (NOT done AND age > 14) AS stalled, coalesce(sum(age - 14) FILTER (NOT done AND age > 14), 0) AS stalled_days, greatest(0, count(*) FILTER (NOT done) - 6) AS stacked FROM o GROUP BY 1, 2),
w AS (SELECT *, greatest(40.0 * blocked, 8.0 * waiting, 6.0 * stalled_days, 2.0 * stacked, CASE WHEN active > 0 THEN 0.1 ELSE 0 END) AS weight, CASE WHEN blocked > 0 THEN 'blocked' WHEN waiting > 0 THEN 'waiting' WHEN stalled > 0 THEN 'stalled' WHEN stacked > 0 THEN 'stacked' ELSE 'active' END AS reason FROM n),
r AS (SELECT chain, stage AS bottleneck, reason FROM w QUALIFY row_number() OVER (PARTITION BY chain ORDER BY weight DESC, active DESC, stage) = 1),
t AS (SELECT chain, sum(active)::BIGINT AS active, sum(done)::BIGINT AS done, sum(blocked)::BIGINT AS blocked, sum(waiting)::BIGINT AS waiting, sum(stalled)::BIGINT AS stalled, sum(stalled_days)::BIGINT AS stalled_days, sum(stacked)::BIGINT AS stacked FROM n GROUP BY 1),
x AS (SELECT *, greatest(0, 100 - 40 * blocked - 8 * waiting - 6 * stalled_days - 2 * stacked)::BIGINT AS score FROM t)
SELECT x.*, CASE WHEN blocked > 0 THEN 'bad' WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'warn' ELSE 'bad' END AS tier, bottleneck, reason FROM x JOIN r USING (chain)""")
def chain_health(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderpriority").alias("stage"), "o_orderstatus", "o_totalprice", "o_orderdate")
    s = F.col("o_orderstatus")
    h = report.chain_health(o, "chain", "stage", s == "F", s == "P", (s == "O") & (F.col("o_totalprice") > 300000), F.datediff(F.lit("1996-01-10").cast("date"), F.to_date("o_orderdate")))
    return h.withColumn("score", F.col("score").cast("long"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_orderpriority = '1-URGENT' THEN 'now' WHEN o_totalprice > 300000 THEN 'owner' WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'queue' END AS lane, count(*) AS n FROM orders GROUP BY 1""")
def routing_lane(spark, sf_dir):
    lane = F.when(F.col("o_orderstatus") == "P", "blocked").when(F.col("o_orderpriority") == "1-URGENT", "now").when(F.col("o_totalprice") > 300000, "owner").when(F.col("o_orderstatus") == "F", "archive").otherwise("queue")
    return table(spark, sf_dir, "orders").groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, count(o_orderkey) AS orders, count(DISTINCT c_custkey) FILTER (o_orderkey IS NULL) AS idle FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def stage_buckets(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("k"))
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("orders"), F.count_if(F.col("k").isNull()).alias("idle"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT c_nationkey, count(*) AS orders, sum(lines)::BIGINT AS lines, count(*) FILTER (o_orderstatus = 'F') AS done, bool_and(o_orderstatus = 'F') AS all_done,
strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
FROM orders JOIN customer ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def project_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.sum("k").alias("lines"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"), day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"))


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn, count(*) OVER (PARTITION BY o_custkey, n) AS same FROM n)
SELECT o_custkey, o_orderpriority, n, CASE WHEN same = 1 THEN o_orderpriority END AS unique_top FROM r WHERE rn = 1""")
def majority_value(spark, sf_dir):
    return report.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS no_k FROM events GROUP BY 1""")
def netlog_report(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(k.try_cast("long")).alias("k_sum"), F.count_if(k.isNull()).alias("no_k"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_suppkey) >= 2 AS fans_out FROM lineitem GROUP BY 1")
def fanout(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("suppliers")).withColumn("fans_out", F.col("suppliers") >= 2)


@query("""WITH p AS (SELECT DISTINCT o_orderdate::DATE AS d, o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT DISTINCT a.o_orderkey AS first_order, b.o_orderkey AS second_order FROM p a JOIN p b ON a.d = b.d AND a.l_partkey = b.l_partkey AND a.o_orderkey < b.o_orderkey""")
def same_event_pairs(spark, sf_dir):
    """Same date and a shared part: an equi-join on both, not all pairs of a date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    n = joins.parts(lines)
    met = lines.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joins.sharing_pairs(met.select("d", "o_orderkey", "l_partkey"), "o_orderkey", ["d", "l_partkey"], "first_order", "second_order", n)


_KEYS = f"SELECT doc_id, md5(text) AS k1, CASE WHEN length(text) > 100 THEN left({TEXT}, 40) ELSE '' END AS k2, CASE WHEN n_chars > 500 THEN right({TEXT}, 40) ELSE '' END AS k3 FROM documents"


@query(f"""WITH k AS ({_KEYS}), a AS (SELECT * FROM k WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS other, k1, k2, k3 FROM k WHERE doc_id % 2 = 1),
h AS (SELECT doc_id, other FROM a JOIN b USING (k1) UNION SELECT doc_id, other FROM a JOIN b USING (k2) WHERE k2 <> '' UNION SELECT doc_id, other FROM a JOIN b USING (k3) WHERE k3 <> '')
SELECT doc_id, array_to_string(list(other ORDER BY other), ',') AS matches FROM h GROUP BY 1""")
def or_key_match(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents"))
    k = d.select("doc_id", F.md5("text").alias("k1"), F.when(F.length("text") > 100, F.left("norm", F.lit(40))).otherwise("").alias("k2"), F.when(F.col("n_chars") > 500, F.right("norm", F.lit(40))).otherwise("").alias("k3"))
    b = k.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "other")
    return joins.match_any(k.where("doc_id % 2 = 0"), b, "doc_id", "other", ["k1", "k2", "k3"], lambda m: F.concat_ws(",", m.cast("array<string>")))


@query("""WITH b AS (SELECT md5(text) AS h, left(text, 30) AS p FROM benchmark) SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.h = md5(d.text)) AND NOT EXISTS (SELECT 1 FROM b WHERE b.p = left(d.text, 30))""")
def anti_join_seen(spark, sf_dir):
    keyed = lambda d: d.withColumns({"h": F.md5("text"), "p": F.left("text", F.lit(30))})
    return dedup.unseen(keyed(table(spark, sf_dir, "documents")), keyed(table(spark, sf_dir, "benchmark")), ["h", "p"]).select("doc_id", "lang")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def semi_scope(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(l, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("""SELECT 'label_without_document' AS finding, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def referential_audit(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    found = [("label_without_document", joins.missing(t("labels"), t("documents"), "doc_id")), ("document_without_label", joins.missing(t("documents"), t("labels"), "doc_id")), ("order_without_customer", joins.missing(t("orders"), t("customer"), "o_custkey", "c_custkey")), ("line_without_order", joins.missing(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"))]
    out = None
    for name, d in found:
        row = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT d.doc_id, coalesce(l.quality, m.quality) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN labels m ON m.doc_id = d.doc_id - 1""")
def multi_key_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") - 1).alias("before"))
    return joins.lookup_first(d, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "key"), [("doc_id", "key"), ("before", "key")], "quality").select("doc_id", "quality")


@query("""WITH a AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS was FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS now FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
j AS (SELECT user_id, coalesce(was, []) AS was, coalesce(now, []) AS now FROM a FULL JOIN b USING (user_id))
SELECT user_id, array_to_string(list_filter(now, lambda x: NOT list_contains(was, x)), ',') AS added, array_to_string(list_filter(was, lambda x: NOT list_contains(now, x)), ',') AS removed, was = now AS same FROM j""")
def collection_diff(spark, sf_dir):
    e, cut = table(spark, sf_dir, "events"), F.lit("2024-01-16").cast("timestamp")
    d = joins.collection_diff(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "user_id", "event_type")
    return d.select("user_id", F.concat_ws(",", "added").alias("added"), F.concat_ws(",", "removed").alias("removed"), "same")


@query("""WITH j AS (SELECT length(text) < 600 AS said, quality = 0 AS bad FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (said AND bad) AS tp, count(*) FILTER (said AND NOT bad) AS fp, count(*) FILTER (NOT said AND bad) AS fn FROM j)
SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall, (fn = 0 AND 10 * tp >= 9 * (tp + fp)) AS passed FROM c""")
def precision_recall(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf_dir, "labels"), "doc_id")
    return report.precision_recall(j, F.col("n") < 600, F.col("quality") == 0)


@query()
def cer(spark, sf_dir):
    """Edits over code points; DuckDB counts bytes, so a test holds this against a plain loop."""
    a = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("x"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return a.join(b, "item_id").select("item_id", F.levenshtein("x", "y").cast("long").alias("edits"), F.round(fx.error_rate(F.col("x"), F.col("y")), 4).alias("cer"))


@query("""SELECT reason, n FROM (SELECT 'short' AS reason, count(*) FILTER (n_chars < 200) AS n FROM documents UNION ALL SELECT 'markup', count(*) FILTER (contains(text, '|')) FROM documents UNION ALL SELECT 'digits', count(*) FILTER (regexp_matches(text, '[0-9]{6}')) FROM documents UNION ALL SELECT 'no_language', count(*) FILTER (lang IS NULL) FROM documents)""")
def exclusion_reasons(spark, sf_dir):
    why = fx.failing(short=F.col("n_chars") < 200, markup=F.contains("text", F.lit("|")), digits=F.col("text").rlike("[0-9]{6}"), no_language=F.col("lang").isNull())
    return report.exclusions(table(spark, sf_dir, "documents"), why, ["short", "markup", "digits", "no_language"])


@query("SELECT user_id, count(*) AS n, bool_or(value > 99) AS unbounded FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 10 AND NOT bool_or(value > 99)")
def decision_having(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or(F.col("value") > 99).alias("unbounded"))
    return e.where("n >= 10 and not unbounded")


@query(f"""WITH RECURSIVE k AS (SELECT doc_id, md5({TEXT}) AS h FROM documents), e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b ON a.h = b.h WHERE a.doc_id <> b.doc_id UNION SELECT doc_id, doc_id - doc_id % 20 FROM documents WHERE doc_id % 20 < 2 UNION SELECT doc_id - doc_id % 20, doc_id FROM documents WHERE doc_id % 20 < 2),
r AS (SELECT x AS node, x AS reach FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents")).select("doc_id", F.md5("norm").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    same = d.join(first, "h").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    near = d.where("doc_id % 20 < 2").select(F.col("doc_id").alias("a"), (F.col("doc_id") - F.col("doc_id") % 20).alias("b"))
    return graph.components(same.unionByName(near), "a", "b")


@query("""SELECT 'r' || r_regionkey AS node, 0 AS depth, printf('%012d', r_regionkey) AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, printf('%012d', n_regionkey) || '/' || printf('%012d', n_nationkey) FROM nation
UNION ALL SELECT 'c' || c_custkey, 2, printf('%012d', n_regionkey) || '/' || printf('%012d', n_nationkey) || '/' || printf('%012d', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tree_layout(spark, sf_dir):
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("o"))
    n = table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("node"), named("r", "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("o"))
    c = table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("node"), named("n", "c_nationkey").alias("parent"), F.col("c_custkey").cast("long").alias("o"))
    return graph.tree_paths(r.unionByName(n).unionByName(c), "node", "parent", "o")


@query("""WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS s, 'p' || l_partkey AS d FROM lineitem WHERE l_quantity >= 45), b AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
h0 AS (SELECT 'o1' AS node, 0 AS hop UNION SELECT 'o2', 0 UNION SELECT 'o3', 0), h1 AS (SELECT * FROM h0 UNION ALL SELECT d, 1 FROM b JOIN h0 ON s = node), h2 AS (SELECT * FROM h1 UNION ALL SELECT d, 2 FROM b JOIN h1 ON s = node WHERE hop = 1)
SELECT node, min(hop)::INTEGER AS hop FROM h2 GROUP BY 1""")
def khop(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graph.neighbourhood(e, spark.createDataFrame([("o1",), ("o2",), ("o3",)], "node string"), 2)


_RANK = "CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END"


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, {_RANK} AS rank, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS is_new FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, is_new, event_id) AS rn FROM e) SELECT user_id, event_id, event_type, rank FROM r WHERE rn = 1""")
def relation_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.expr(_RANK).alias("rank"))
    return graph.upsert_ranked(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"), "user_id", "rank", "event_id")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), count(*) OVER (PARTITION BY conv_id)) AS section_end FROM conversations")
def section_lead(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return report.sections(c, "conv_id", "turn", F.count("*").over(Window.partitionBy("conv_id")))


@query("""SELECT 'doc_id' AS rule, count(*) AS n FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'o_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'negative_price', count(*) FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'empty_text', count(*) FROM documents WHERE coalesce(text, '') = ''""")
def violations(spark, sf_dir):
    d, o = table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders")
    found = {"doc_id": dedup.repeated(d, "doc_id"), "o_custkey": dedup.repeated(o, "o_custkey"), "negative_price": o.where("o_totalprice < 0"), "empty_text": d.where("coalesce(text, '') = ''")}
    out = None
    for name, rows in found.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS phases, count(*) FILTER (event_type = 'error') > 0 AS failed, arg_min(event_type, (ts, event_id)) AS first_phase, arg_max(event_type, (ts, event_id)) AS last_phase FROM events GROUP BY ALL""")
def request_assembly(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    at = F.struct("ts", "event_id")
    return e.groupBy("user_id", "hour").agg(F.count("*").alias("phases"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.min_by("event_type", at).alias("first_phase"), F.max_by("event_type", at).alias("last_phase"))


@query("""WITH v AS (SELECT user_id, event_id AS view_id, ts AS vts FROM events WHERE event_type = 'view'), j AS (SELECT p.event_id, view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY vts DESC, view_id DESC) AS rn FROM events p LEFT JOIN v ON v.user_id = p.user_id AND vts <= p.ts AND vts >= p.ts - INTERVAL 6 HOUR WHERE p.event_type = 'purchase')
SELECT event_id, view_id AS matched_view_id FROM j WHERE rn = 1""")
def interval_enrich(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("vts"))
    p = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return joins.newest_before(p, v, "user_id", "ts", "vts", F.expr("interval 6 hours"), "view_id").select("event_id", "matched_view_id")


@query("""WITH d AS (SELECT user_id, ts::DATE AS d, list(DISTINCT event_type ORDER BY event_type) AS s FROM events GROUP BY ALL), p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY d), []) AS was FROM d)
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, array_to_string(list_filter(s, lambda x: NOT list_contains(was, x)), ',') AS added, array_to_string(list_filter(was, lambda x: NOT list_contains(s, x)), ',') AS removed FROM p""")
def state_diff(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sort_array(F.collect_set("event_type")).alias("s"))
    d = d.withColumn("was", F.coalesce(F.lag("s").over(Window.partitionBy("user_id").orderBy("d")), F.array().cast("array<string>")))
    return d.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"), F.concat_ws(",", F.array_except("s", "was")).alias("added"), F.concat_ws(",", F.array_except("was", "s")).alias("removed"))


@query("SELECT CASE WHEN event_type = 'error' AND value > 50 THEN 'risk' WHEN event_type = 'error' THEN 'retry' WHEN event_type IN ('click', 'view') THEN 'pass' WHEN value IS NULL THEN 'unknown' ELSE 'convert' END AS category, count(*) AS n FROM events GROUP BY 1")
def event_category(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    c = F.when((t == "error") & (v > 50), "risk").when(t == "error", "retry").when(t.isin("click", "view"), "pass").when(v.isNull(), "unknown").otherwise("convert")
    return table(spark, sf_dir, "events").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text))::BIGINT AS starts_at FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), (F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - n).alias("starts_at"))


@query()
def seen_fold(spark, sf_dir):
    d = _norm(table(spark, sf_dir, "documents")).select("doc_id", "source", F.md5("norm").alias("content"), F.left("norm", F.lit(40)).alias("head"))
    return dedup.seen_fold(d, ["content", "head"], "doc_id", "source").select("doc_id", "source")


@query()
def block_diff(spark, sf_dir):
    """Blocks (lines) of each document against those of the one before."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sequence.block_diff(d.withColumnRenamed("text", "after").join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before")), "doc_id"), "doc_id", "before", "after")


@query()
def segment_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return sequence.segments(c, "key", "text")


from lodestone.plans import answers, flows, forests, merges, ordered, outputs, places, records, reviews  # noqa: E402, F401  they register their queries in the tables above
