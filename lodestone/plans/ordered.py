"""Queries of what depends on order: consumption of requests by responses, folds that start anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import layout, ordered
from lodestone.plans.catalogue import query, table
from lodestone.plans.flows import folder
from lodestone.streaming import enrich

_SIX_HOURS = 6 * 3600 * 1000


@query(f"""WITH RECURSIVE e AS (
 SELECT user_id, event_id::VARCHAR AS id, epoch_ms(ts) AS ms, event_type = 'view' AS ask, event_id % 3 AS form, 'h' || (event_id % 2) AS host, event_id % 5 AS q,
        CASE WHEN event_type <> 'view' AND event_id % 4 = 0 THEN '?' ELSE ['GET', 'POST'][1 + event_id % 2] END AS method FROM events WHERE event_type IN ('view', 'purchase')),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, ask DESC, id) AS k FROM e),
 fold AS (
 SELECT user_id, 0::BIGINT AS k, []::STRUCT(id VARCHAR, ms BIGINT, host VARCHAR, q BIGINT, method VARCHAR)[] AS open, NULL::VARCHAR AS asked, NULL::VARCHAR AS answered, NULL::BOOLEAN AS ask FROM n GROUP BY user_id
 UNION ALL
 SELECT user_id, k, CASE WHEN ask THEN list_append(open, me) WHEN hit IS NULL THEN open ELSE list_filter(open, lambda x: x.id <> hit.id) END, hit.id, me.id, ask
 FROM (SELECT n.user_id, n.k, n.ask, open, {{'id': n.id, 'ms': n.ms, 'host': n.host, 'q': n.q, 'method': n.method}} AS me,
       CASE WHEN NOT n.ask THEN list_filter(open, lambda x: n.ms - x.ms <= {_SIX_HOURS} AND n.method IN ('?', x.method) AND CASE WHEN n.form = 0 THEN x.q = n.q ELSE x.host = n.host END)[-1] END AS hit
       FROM fold JOIN n ON n.user_id = fold.user_id AND n.k = fold.k + 1))
SELECT asked AS request_id, answered AS response_id, asked IS NULL AS orphan FROM fold WHERE NOT ask
UNION ALL SELECT id, NULL, false FROM n WHERE ask AND id NOT IN (SELECT asked FROM fold WHERE asked IS NOT NULL)""")
def stream_enrichment(spark, sf_dir):
    """Views are requests, purchases the responses to them: with a path only, or the whole address. The
    stream reads them from files in any order; a clock row ends it."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    ask, k = F.col("event_type") == "view", F.col("event_id")
    host, path, search = F.format_string("https://H%d.example", k % 2), F.format_string("/p/%d", F.col("user_id")), F.format_string("?q=%d", k % 5)
    url = F.when(ask, F.concat(host, path, search)).when(k % 3 == 0, F.concat(path, search, F.lit("#part"))).otherwise(F.concat(F.lower(host), path))
    method = F.when(~ask & (k % 4 == 0), enrich.ANY_METHOD).otherwise(F.when(k % 2 == 0, "GET").otherwise("POST"))
    rows = e.select(F.col("ts").cast("timestamp").alias("at"), F.when(ask, enrich.REQUEST).otherwise(enrich.RESPONSE).alias("kind"), k.cast("string").alias("id"), method.alias("method"), url.alias("url"), F.lit("{}").alias("body"), F.lit(None).cast("string").alias("headers"))
    path, out = folder(spark), folder(spark)
    rows.write.parquet(path)
    clock = rows.agg((F.max("at") + F.expr("interval 20 years")).alias("at")).withColumns({c: F.lit("clock") if c == "kind" else F.lit(None).cast("string") for c in rows.columns[1:]})
    clock.write.mode("append").parquet(path)
    made = enrich.enriched(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path), _SIX_HOURS, "3650 days")
    made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows").select("request_id", "response_id", "orphan")


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 fold AS (SELECT conv_id, 0::BIGINT AS k, -1::BIGINT AS batch, 3::BIGINT AS items, 0::BIGINT AS total FROM n GROUP BY conv_id
 UNION ALL SELECT n.conv_id, n.k, CASE WHEN items >= 3 OR total + size > 900 THEN batch + 1 ELSE batch END, CASE WHEN items >= 3 OR total + size > 900 THEN 1 ELSE items + 1 END, CASE WHEN items >= 3 OR total + size > 900 THEN size ELSE total + size END
 FROM fold JOIN n ON n.conv_id = fold.conv_id AND n.k = fold.k + 1)
SELECT conv_id, turn, batch FROM fold JOIN n USING (conv_id, k)""")
def size_batches(spark, sf_dir):
    """Turns in batches of at most three and 900 characters."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ordered.bounded_batches(c, "conv_id", ["turn"], F.length("text"), 3, 900).select("conv_id", "turn", "batch")


#: Order lines as lines of a page, one page a supplier.
_LINES_SQL = """SELECT l_suppkey AS page, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN 'title' ELSE 'text' END AS kind, (l_partkey % 4 * 30)::DOUBLE AS x0, l_orderkey * 30.0::DOUBLE + l_linenumber * 4 AS y0,
 (l_partkey % 4 * 30)::DOUBLE + 100 + l_quantity::DOUBLE * 8 AS x1, l_orderkey * 30.0::DOUBLE + l_linenumber * 4 + 14 + l_linenumber % 3 * 10 AS y1, CASE WHEN l_partkey % 11 = 0 THEN '12. ' || l_returnflag WHEN l_partkey % 5 = 0 THEN l_returnflag || '-' ELSE l_returnflag END AS line FROM lineitem"""


def _lines(spark, sf_dir):
    k, s = F.col("l_partkey"), F.col("l_returnflag")
    left = (k % 4 * 30).cast("double")
    top = F.col("l_orderkey") * F.lit(30.0) + F.col("l_linenumber") * 4
    said = F.when(k % 11 == 0, F.concat(F.lit("12. "), s)).when(k % 5 == 0, F.concat(s, F.lit("-"))).otherwise(s)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 4 == 0, "title").otherwise("text").alias("kind"), left.alias("x0"), top.alias("y0"), (left + 100 + F.col("l_quantity").cast("double") * 8).alias("x1"), (top + 14 + F.col("l_linenumber") % 3 * 10).alias("y1"), said.alias("line"))


@query(f"""WITH RECURSIVE l AS ({_LINES_SQL}), m AS (SELECT page, quantile_cont(y1 - y0, 0.5) AS med FROM l GROUP BY page),
 n AS (SELECT l.*, med, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, x0 + x1) AS k, CASE WHEN kind = 'title' THEN 6 ELSE 18 END AS most, line LIKE '12. %' OR (y1 - y0 > med * 1.25 AND x1 - x0 < 900 * 0.45) AS head FROM l JOIN m USING (page)),
 fold AS (SELECT page, 0::BIGINT AS k, -1::BIGINT AS block, 99::BIGINT AS items, 0::DOUBLE AS base, 0::DOUBLE AS bottom FROM n GROUP BY page
 UNION ALL SELECT page, k, block + new::BIGINT, CASE WHEN new THEN 1 ELSE items + 1 END, CASE WHEN new THEN x0 ELSE base END, y1 FROM (
  SELECT n.page, n.k, block, items, base, x0, y1, items >= most OR y0 - bottom > greatest(42.0, med * 2.2) OR (y0 - bottom > med * 0.75 AND abs(x0 - base) > greatest(32.0, med * 1.2)) OR (kind <> 'title' AND head AND y0 - bottom > med * 0.35) AS new
  FROM fold JOIN n ON n.page = fold.page AND n.k = fold.k + 1))
SELECT page, l_orderkey, l_linenumber, block FROM fold JOIN n USING (page, k)""")
def line_blocks(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("width", F.lit(900.0))
    return ordered.line_blocks(lines, "page", "kind", "x0", "y0", "x1", "y1", "line", "width").select("page", "l_orderkey", "l_linenumber", "block")


@query(f"""WITH l AS ({_LINES_SQL}), m AS (SELECT page, greatest(10.0, quantile_cont(y1 - y0, 0.5) * 1.85) AS gap FROM l GROUP BY page),
 n AS (SELECT l.*, CASE WHEN line LIKE '12. %' OR y0 - lag(y1) OVER w > gap THEN 1 ELSE 0 END AS new FROM l JOIN m USING (page) WINDOW w AS (PARTITION BY page ORDER BY y0, x0, line)),
 p AS (SELECT *, sum(CASE WHEN first THEN 0 ELSE new END) OVER (PARTITION BY page ORDER BY y0, x0, line) AS paragraph FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, line) = 1 AS first FROM n))
SELECT page, paragraph::BIGINT AS paragraph, count(*)::INTEGER AS lines, list_reduce(list(line ORDER BY y0, x0, line), lambda a, x: CASE WHEN a LIKE '%-' THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END) AS text FROM p GROUP BY page, paragraph""")
def line_paragraphs(spark, sf_dir):
    return ordered.paragraphs(_lines(spark, sf_dir), "page", ["y0", "x0", "line"], "y0", "y1", "line")


#: Order lines as lines of pages (one a supplier and month) with CJK and Latin words.
_SHEET_SQL = """SELECT l_suppkey * 100 + month(l_shipdate) AS page, l_orderkey, l_linenumber, l_partkey, l_quantity, ['中', '文。', 'Table', '表格数据', 'the data 数', 'A', '7', '表', '中'][1 + l_partkey % 9] AS words, 8.0::DOUBLE + l_linenumber % 4 * 2 AS size,
 [-1.0, 50.0, 52.0, 51.0, 150.0, 50.0][1 + l_orderkey % 6]::DOUBLE AS x0, (l_orderkey % 4000 * 2 + l_linenumber * 5)::DOUBLE AS y0, [-1.0, 50.0, 52.0, 51.0, 150.0, 50.0][1 + l_orderkey % 6]::DOUBLE + 8 + l_quantity::DOUBLE AS x1, (l_orderkey % 4000 * 2 + l_linenumber * 5)::DOUBLE + 4 + l_linenumber % 3 * 4 AS y1 FROM lineitem"""


@query(f"""WITH RECURSIVE l AS ({_SHEET_SQL}), n AS (SELECT *, lower(regexp_replace(words, '[^0-9A-Za-z㐀-鿿]', '', 'g')) AS w, length(regexp_replace(words, '[^㐀-鿿]', '', 'g')) AS cjk, length(regexp_replace(words, '[^A-Za-z]', '', 'g')) AS latin,
  length(replace(words, ' ', '')) AS bare, row_number() OVER (PARTITION BY page ORDER BY y0, x0, l_orderkey, l_linenumber, l_partkey, l_quantity) AS k FROM l),
 j AS (SELECT a.page, a.k, b.k AS b, b.y0 > a.y1 + 3 AS below, a.words AS aw, b.words AS bw, least(a.x0, b.x0) AS ux0, least(a.y0, b.y0) AS uy0, greatest(a.x1, b.x1) AS ux1, greatest(a.y1, b.y1) AS uy1,
  greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1.0, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))) AS share,
  abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 2 AS beside, (a.cjk > 0 AND (b.cjk > 0 OR b.latin >= 2)) OR (b.cjk > 0 AND a.latin >= 2) AS mixed, a.w = b.w OR (least(length(a.w), length(b.w)) >= 6 AND (contains(a.w, b.w) OR contains(b.w, a.w))) AS twice,
  least(length(a.w), length(b.w)) <= 12 AND greatest(a.size, b.size) >= 12.65 AS plain FROM n a JOIN n b ON a.page = b.page AND b.k BETWEEN a.k + 1 AND a.k + 9),
 s AS (SELECT page, k, min(b) FILTER (WHERE below) AS stop FROM j GROUP BY ALL),
 hit AS (SELECT page, 'overlap' AS kind, aw || ' / ' || bw AS evidence, ux0, uy0, ux1, uy1 FROM j JOIN s USING (page, k) WHERE b < coalesce(stop, b + 1) AND mixed AND share >= 0.65 AND NOT twice AND NOT (beside AND share < 0.82) AND plain QUALIFY row_number() OVER (PARTITION BY page, k ORDER BY b) = 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS i FROM n WHERE cjk = 1 AND bare <= 2),
 grow AS (SELECT page, i AS start, i, words AS said, x0, x1, y0, y1, x0 AS ux0, y0 AS uy0, x1 AS ux1, y1 AS uy1 FROM o
  UNION ALL SELECT o.page, start, o.i, said || words, o.x0, o.x1, o.y0, o.y1, least(ux0, o.x0), least(uy0, o.y0), greatest(ux1, o.x1), greatest(uy1, o.y1) FROM grow g JOIN o ON o.page = g.page AND o.i = g.i + 1 AND o.i <= start + 7
   AND abs((o.x0 + o.x1) / 2 - (g.x0 + g.x1) / 2) <= greatest(5.0, (g.x1 - g.x0) * 1.4) AND o.y0 - g.y1 BETWEEN 0 AND greatest(16.0, (g.y1 - g.y0) * 2.2)),
 st AS (SELECT page, 'stack' AS kind, said AS evidence, ux0, uy0, ux1, uy1 FROM grow WHERE i >= start + 2 QUALIFY row_number() OVER (PARTITION BY page ORDER BY start, i DESC) = 1)
SELECT page, kind, evidence, ux0 AS x0, uy0 AS y0, ux1 AS x1, uy1 AS y1 FROM (SELECT * FROM hit UNION ALL SELECT * FROM st UNION ALL
 SELECT page, 'clipped', 'outside: ' || words, x0, y0, x1, y1 FROM n WHERE x0 < -0.5 OR y0 < -0.5 OR x1 > 200.5 OR y1 > 7900.5 UNION ALL
 SELECT page, 'clipped', 'fragment: ' || words, x0, y0, x1, y1 FROM n WHERE (cjk = 1 AND bare <= 2 AND (x1 >= 198 OR x0 <= 2)) OR (bare = 1 AND words <> '7' AND x0 > 144))""")
def layout_issues(spark, sf_dir):
    k = F.col("l_orderkey")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    left, top = pick([-1.0, 50.0, 52.0, 51.0, 150.0, 50.0], k % 6), (k % 4000 * 2 + F.col("l_linenumber") * 5).cast("double")
    words = pick(["中", "文。", "Table", "表格数据", "the data 数", "A", "7", "表", "中"], F.col("l_partkey") % 9)
    sheet = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") * 100 + F.month("l_shipdate")).alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", words.alias("words"), (F.lit(8.0) + F.col("l_linenumber") % 4 * 2).alias("size"), left.alias("x0"), top.alias("y0"),
        (left + 8 + F.col("l_quantity").cast("double")).alias("x1"), (top + 4 + F.col("l_linenumber") % 3 * 4).alias("y1"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(200.0).alias("right"), F.lit(7900.0).alias("bottom"), F.lit(11.0).alias("median"),
    )
    return layout.layout_issues(sheet, "page", "words", "size", ("left", "top", "right", "bottom"), "median", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
