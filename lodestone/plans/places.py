"""Queries of what is found where: quotes in texts, candidates for expected events, lines in blocks, tables
and the text around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import matching, quotes, spatial
from lodestone.plans.catalogue import query, table

#: The second word of a turn as a quote from it, with contexts of one or two characters.
_QUOTES_SQL = r"""c AS (SELECT conv_id, turn, role, text, regexp_extract(text, '^\S+ (\S+)', 1) AS q, CASE turn % 3 WHEN 0 THEN 'e ' WHEN 1 THEN ' ' ELSE '' END AS pre, CASE WHEN turn % 2 = 0 THEN ' ' ELSE ', ' END AS suf FROM conversations),
 s AS (SELECT *, CASE WHEN q = '' THEN [text] ELSE string_split(text, q) END AS parts FROM c),
 p AS (SELECT *, list_transform(range(1, len(parts)), lambda k: (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(q))::INTEGER) AS at_ FROM s)"""


def _quotes(spark, sf_dir):
    turn = F.col("turn")
    pre = F.when(turn % 3 == 0, "e ").when(turn % 3 == 1, " ").otherwise("")
    suf = F.when(turn % 2 == 0, " ").otherwise(", ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.regexp_extract("text", r"^\S+ (\S+)", 1).alias("q"), pre.alias("pre"), suf.alias("suf"))


@query(f"""WITH {_QUOTES_SQL},
 w AS (SELECT *, list_transform(at_, lambda i: CASE WHEN pre <> '' AND i > 0 AND substr(text, greatest(1, i - length(pre) + 1), least(i, length(pre))::BIGINT) = pre THEN 2 ELSE 0 END + CASE WHEN substr(text, i + length(q) + 1, length(suf)) = suf THEN 2 ELSE 0 END) AS score FROM p),
 b AS (SELECT *, list_max(score) AS most, len(list_filter(score, lambda x: x = list_max(score))) AS ties, list_contains(at_, 10) AND role = 'user' AS same FROM w)
SELECT conv_id, turn, CASE len(at_) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE CASE WHEN same THEN 'exact-revision' WHEN most > 0 AND ties = 1 THEN 'context' ELSE 'ambiguous' END END AS state,
 CASE len(at_) WHEN 0 THEN -1 WHEN 1 THEN at_[1] ELSE CASE WHEN same THEN 10 WHEN most > 0 AND ties = 1 THEN at_[list_position(score, most)] ELSE -1 END END AS index, len(at_)::INTEGER AS found FROM b""")
def quote_resolution(spark, sf_dir):
    """Each turn's quote where it was recorded, or where its context fits; the user's turns have not changed."""
    rows = _quotes(spark, sf_dir).withColumns({"recorded": F.lit(10), "now": F.lit("user")})
    made = quotes.resolve(rows, "text", "q", "pre", "suf", "recorded", "role", "now")
    return made.select("conv_id", "turn", "state", "index", F.size("matches").alias("found"))


@query(r"""WITH c AS (SELECT conv_id, turn, replace(text, ' the ', ' "the" ') AS text FROM conversations),
 q AS (SELECT *, '"' || regexp_extract(text, '^\S+ (\S+)', 1) || '"' AS q FROM c), s AS (SELECT *, string_split(text, q) AS parts FROM q),
 p AS (SELECT *, list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(q)) AS at_ FROM s)
SELECT conv_id, turn, CASE len(at_) WHEN 0 THEN 'unverified_missing' WHEN 1 THEN 'verified_unique' ELSE 'verified_ambiguous' END AS verification_state,
 CASE len(at_) WHEN 0 THEN 'quote_exact' WHEN 1 THEN 'quote_normalized_unique' ELSE 'quote_normalized_ambiguous' END AS match_strategy, array_to_string(at_, ',') AS positions FROM p""")
def quote_verification(spark, sf_dir):
    """Quotes in curly quotation marks from texts that have straight ones."""
    rows = _quotes(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" the "), F.lit(' "the" ')))
    rows = rows.withColumn("q", F.concat(F.lit("“"), F.regexp_extract("text", r"^\S+ (\S+)", 1), F.lit("”")))
    made = quotes.verify(rows, "text", "q", "pre", "suf")
    return made.select("conv_id", "turn", "verification_state", "match_strategy", F.array_join("positions", ",").alias("positions"))


_EXPECTED_SQL = """SELECT s_name AS gold_id, s_suppkey AS place, ['', '^[a-m]', 'g$', 'e.*t'][1 + s_suppkey % 4] AS pattern, CASE WHEN s_suppkey % 3 > 0 THEN ['ECONOMY', 'PROMO', 'LARGE', 'SMALL', 'MEDIUM'][1 + s_nationkey % 5] END AS type, CASE WHEN s_suppkey % 7 > 0 THEN 'Brand#' || (1 + s_suppkey % 25) END AS basis, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS date FROM supplier"""


def _matched(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_name").alias("title"), F.col("p_type").alias("event_type"), F.col("p_brand").alias("basis"), F.col("p_size").cast("long").alias("date"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    e = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("gold_id"), k.cast("long").alias("place"), pick(["", "^[a-m]", "g$", "e.*t"], k % 4).alias("title_regex"), F.when(k % 3 > 0, pick(["ECONOMY", "PROMO", "LARGE", "SMALL", "MEDIUM"], n % 5)).alias("event_type"), F.when(k % 7 > 0, F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("basis"), F.when(k % 2 == 0, n.cast("long")).alias("date"))
    return matching.matched(c, e)


_MATCHED_SQL = f"""RECURSIVE e AS ({_EXPECTED_SQL}), n AS (SELECT *, row_number() OVER (ORDER BY place) AS k FROM e),
 fit AS (SELECT k, list(p_partkey ORDER BY p_partkey) AS fits FROM n JOIN part ON regexp_matches(p_name, pattern) AND (type IS NULL OR type = p_type) AND (basis IS NULL OR basis = p_brand) GROUP BY k),
 a AS (SELECT n.*, coalesce(fits, []) AS fits FROM n LEFT JOIN fit USING (k)),
 fold AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS won, 0::BIGINT AS found
 UNION ALL SELECT k, CASE WHEN len(open) = 1 THEN list_append(used, open[1]) ELSE used END, CASE WHEN len(open) = 1 THEN open[1] END, len(open)
 FROM (SELECT a.k, used, list_filter(fits, lambda x: NOT list_contains(used, x)) AS open FROM fold JOIN a ON a.k = fold.k + 1)),
 result AS (SELECT gold_id, won IS NOT NULL AS matched, won::VARCHAR AS candidate_id, found AS match_count, CASE WHEN date IS NULL THEN 'not_scored' WHEN p_size = date THEN 'exact' WHEN won IS NULL THEN 'unknown' ELSE 'mismatch' END AS date_status
 FROM fold JOIN n USING (k) LEFT JOIN part ON p_partkey = won)"""


@query(f"WITH {_MATCHED_SQL} SELECT * FROM result")
def expected_matches(spark, sf_dir):
    """Suppliers as expected events, parts as candidates: each takes the only part left that fits it."""
    return _matched(spark, sf_dir).select("gold_id", "matched", "candidate_id", "match_count", "date_status")


@query(f"""WITH {_MATCHED_SQL} SELECT count(*) AS expected_events, count(*) FILTER (matched) AS matched_events, count(*) FILTER (matched) / count(*) AS anchor_recall,
 count(*) FILTER (date_status <> 'not_scored') AS expected_dates, count(*) FILTER (date_status = 'exact') AS exact_dates, count(*) FILTER (date_status = 'exact') / count(*) FILTER (date_status <> 'not_scored') AS exact_date_recall FROM result""")
def expected_recall(spark, sf_dir):
    return matching.recall(_matched(spark, sf_dir))


#: Parts as boxes on forty pages, order lines as points.
_BOXES_SQL = "SELECT p_partkey AS box, p_partkey % 40 AS page, (p_partkey * 37 % 900)::DOUBLE AS x0, (p_partkey * 53 % 1200)::DOUBLE AS y0, (p_partkey * 37 % 900 + 40 + p_size * 4)::DOUBLE AS x1, (p_partkey * 53 % 1200 + 20 + p_size)::DOUBLE AS y1 FROM part"
_SIDES = ("x0", "y0", "x1", "y1")


def _boxes(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 37 % 900).cast("double"), (k * 53 % 1200).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("box"), (k % 40).alias("page"), x.alias("x0"), y.alias("y0"), (x + 40 + s * 4).alias("x1"), (y + 20 + s).alias("y1"))


@query(f"""WITH b AS ({_BOXES_SQL}), p AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_orderkey % 40 AS page, (l_orderkey * 71 % 1100)::DOUBLE AS x, (l_orderkey * 29 % 1300 + l_linenumber)::DOUBLE AS y FROM lineitem),
 j AS (SELECT p.id, p.page, b.box, x >= x0 AND x < x1 AND y >= y0 AND y < y1 AS inside, abs(y0 - y) AS off FROM p JOIN b ON b.page = p.page),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE off END, box) AS n FROM j)
SELECT page, id, box FROM r WHERE n = 1""")
def points_in_boxes(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    points = table(spark, sf_dir, "lineitem").select((o * 8 + n).alias("id"), (o % 40).alias("page"), (o * 71 % 1100).cast("double").alias("x"), (o * 29 % 1300 + n).cast("double").alias("y")).distinct()
    return spatial.assign(points, _boxes(spark, sf_dir).withColumn("order", F.col("box")), "page", "id", "x", "y", "box", "order", _SIDES)


@query(f"""WITH b AS ({_BOXES_SQL}), t AS (SELECT o_orderkey AS id, o_orderkey % 40 AS page, CASE WHEN o_orderkey % 9 = 0 THEN 'Page 3' ELSE o_orderstatus END AS said, (o_orderkey * 13 % 1000)::DOUBLE AS x0, (o_orderkey * 7 % 1300)::DOUBLE AS y0, (o_orderkey * 13 % 1000 + 150)::DOUBLE AS x1, (o_orderkey * 7 % 1300 + 18)::DOUBLE AS y1 FROM orders),
 j AS (SELECT t.page, t.id, b.box, t.said, t.x0, t.y0, t.x1, t.y1, CASE WHEN b.y0 - t.y1 BETWEEN 0 AND 72 THEN 'above' WHEN b.y0 < t.y1 AND t.y0 - b.y1 BETWEEN 0 AND 150 THEN 'below' END AS position, CASE WHEN b.y0 >= t.y1 THEN b.y0 - t.y1 ELSE t.y0 - b.y1 END AS distance
 FROM t JOIN b ON b.page = t.page WHERE said <> 'Page 3' AND greatest(0, least(t.x1, b.x1) - greatest(t.x0, b.x0)) / greatest(1.0::DOUBLE, least(t.x1 - t.x0, b.x1 - b.x0)) >= 0.35),
 r AS (SELECT *, row_number() OVER (PARTITION BY page, said, x0, y0, x1, y1 ORDER BY box, id) AS n FROM j WHERE position IS NOT NULL)
SELECT page, box, id, position, distance FROM r WHERE n = 1""")
def table_companions(spark, sf_dir):
    k = F.col("o_orderkey")
    x, y = (k * 13 % 1000).cast("double"), (k * 7 % 1300).cast("double")
    texts = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 40).alias("page"), F.when(k % 9 == 0, "Page 3").otherwise(F.col("o_orderstatus")).alias("said"), x.alias("x0"), y.alias("y0"), (x + 150).alias("x1"), (y + 18).alias("y1"))
    return spatial.companions(texts, _boxes(spark, sf_dir), "page", "id", "box", "said", _SIDES)
