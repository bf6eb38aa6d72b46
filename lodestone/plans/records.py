"""Queries on records, cards and ledgers: filters, joins, aggregations, folds, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import predicates as px
from lodestone.functions import text as fx
from lodestone.operators import dedup, graph, joins, report, review
from lodestone.plans.catalogue import NORM, TEXT, query, table

_RAW_DATE = "CASE doc_id % 6 WHEN 0 THEN 'on 2024/3/' || (doc_id % 28 + 1) || ', late' WHEN 1 THEN '2024 Mar ' || (doc_id % 28 + 1) WHEN 2 THEN '2024-03-07T10:00:00Z' WHEN 3 THEN 'Thu, 7 Mar 2024 10:00:00 +0000' WHEN 4 THEN '2024-13-40' ELSE 'soon' END"
_DAY_SQL = "CASE doc_id % 6 WHEN 0 THEN strftime(DATE '2024-03-01' + (doc_id % 28)::INTEGER, '%Y-%m-%d') WHEN 1 THEN strftime(DATE '2024-03-01' + (doc_id % 28)::INTEGER, '%Y-%m-%d') WHEN 2 THEN '2024-03-07' WHEN 3 THEN '2024-03-07' ELSE '' END"
_URL = "CASE doc_id % 4 WHEN 0 THEN 'HTTPS://WWW.Example.org' WHEN 1 THEN 'http://a.example.org//x///' || doc_id || '?q=1#top' WHEN 2 THEN 'ftp://b.example.org/' ELSE '' END"
_URL_SQL = "CASE doc_id % 4 WHEN 0 THEN 'https://www.example.org/' WHEN 1 THEN 'http://a.example.org/x/' || doc_id || '?q=1' ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, source, trim(left({TEXT}, 50)) AS title, {TEXT} AS summary, {_URL_SQL} AS url, CASE WHEN doc_id % 7 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi, {_DAY_SQL} AS published_at FROM documents)
SELECT doc_id, title, url, published_at, doi, CASE WHEN doi <> '' THEN 'doi:' || doi WHEN url <> '' THEN 'url:' || url WHEN title <> '' THEN 'fallback:' || left(sha256(lower(source) || '|' || lower(title)), 20) ELSE '' END AS item_id,
 'a|b' AS tags, source || '/' || doc_id AS provenance FROM d""")
def item_contract(spark, sf_dir):
    """Heterogeneous source rows as canonical items: aliases, URL, date, identifiers, identity, tags."""
    d = table(spark, sf_dir, "documents")
    raw = d.select("doc_id", "source", F.lit(None).cast("string").alias("title"), F.left(fx.compact("text"), F.lit(50)).alias("name"), F.expr(_URL).alias("link"), F.expr(_RAW_DATE).alias("date"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'https://doi.org/10.1/' || doc_id END").alias("doi"), F.lit("A; b,a").alias("tags"))
    doi, url, title = fx.doi("doi"), fx.normalise_url(fx.first_filled("link")), fx.first_filled("title", "name")
    none = F.lit(None).cast("string")
    return raw.select("doc_id", title.alias("title"), url.alias("url"), fx.normalise_date("date").alias("published_at"), doi.alias("doi"), fx.identity(none, doi, none, url, F.col("source"), title).alias("item_id"), F.array_join(fx.split_list(F.lower("tags"), 20), "|").alias("tags"), F.concat_ws("/", "source", "doc_id").alias("provenance"))


@query("""WITH s AS (SELECT user_id, value > 150 AS required, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'ok_no_updates' WHEN 'click' THEN 'partial' ELSE 'ok' END AS status FROM events WHERE value > 40),
r AS (SELECT user_id, count(*) AS sources, count(*) FILTER (required) AS required, count(*) FILTER (required AND status = 'failed') AS rf, count(*) FILTER (required AND status IN ('ok', 'ok_no_updates')) AS ro, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('partial', 'warning') OR (NOT required AND status = 'failed')) AS warnings FROM s GROUP BY 1)
SELECT user_id, sources, required, failed, warnings, CASE WHEN required > 0 THEN CASE WHEN rf = required THEN 'failed' WHEN rf > 0 THEN 'degraded' WHEN warnings > 0 THEN 'complete_with_warning' WHEN ro > 0 THEN 'complete' ELSE 'degraded' END
 WHEN failed = sources THEN 'failed' WHEN warnings > 0 THEN 'complete_with_warning' ELSE 'complete' END AS health FROM r""")
def daily_health(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 40")
    t = F.col("event_type")
    status = F.when(t == "error", "failed").when(t == "signup", "warning").when(t == "view", "ok_no_updates").when(t == "click", "partial").otherwise("ok")
    return report.health_status(e, F.col("value") > 150, status, "user_id")


_CARD = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'P' THEN 'review' ELSE 'todo' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'backstage' WHEN 2 THEN 'team' END AS scope, CASE o_orderkey % 3 WHEN 0 THEN 'PI-gated' WHEN 1 THEN 'shared' END AS responsibility, CASE o_orderkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'bot' WHEN 2 THEN ' ' END AS assignee, CASE o_orderkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS human_gate, CASE o_orderkey % 11 WHEN 0 THEN 'Log' ELSE 'card' END AS doc_type, o_orderpriority AS priority, o_orderdate AS updated, o_custkey FROM orders"


def cards(spark, sf_dir):
    """Orders as task cards."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_as_cards")
    return spark.sql(_CARD.replace("FROM orders", "FROM orders_as_cards"))


@query(f"""WITH c AS ({_CARD}), k AS (SELECT *, lower(trim(coalesce(scope, ''))) AS sc, lower(trim(coalesce(responsibility, ''))) AS re, lower(trim(coalesce(assignee, ''))) AS ac, lower(doc_type) IN ('record', 'receipt', 'log', 'ledger', 'pointer') OR coalesce(scope, '') = 'backstage' AS backstage, date_diff('day', updated::DATE, DATE '1998-08-01') AS age FROM c),
g AS (SELECT *, NOT backstage AND lower(status) <> 'done' AND (sc IN ('owner', 'human', 'pi') OR re IN ('owner-gated', 'human-gated', 'pi-gated') OR (coalesce(human_gate, '') = 'yes' AND ac IN ('', 'owner'))) AS needs FROM k)
SELECT o_orderkey, backstage, needs AS requires_role, lower(status) IN ('todo', 'review') AND needs AND NOT (priority = '5-LOW') AND NOT backstage AS owner_action, lower(status) = 'done' AND age BETWEEN 0 AND 3 AND ac = 'bot' AS recently_done, age > 30 AS stale, strftime(updated, '%Y-%m-%d') > '1997-06-01' AS drifted,
 contains(lower(concat_ws(' ', status, scope, priority)), 'urgent') AS found, contains(lower(concat_ws(' ', scope, assignee)), 'bot') OR contains(lower(concat_ws(' ', scope, assignee)), 'team') AS people FROM g""")
def card_predicates(spark, sf_dir):
    c, col = cards(spark, sf_dir), F.col
    backstage = px.is_backstage(col("doc_type"), col("scope"), F.lit(None))
    needs = px.requires_role(col("status"), col("scope"), col("responsibility"), col("assignee"), col("human_gate"), backstage)
    now, day = F.lit("1998-08-01").cast("date"), F.to_date("updated")
    return c.select("o_orderkey", backstage.alias("backstage"), needs.alias("requires_role"), px.owner_action_needed(col("status"), needs, col("priority") == "5-LOW", backstage).alias("owner_action"), px.recently_done(col("status"), F.datediff(now, day), col("assignee"), ["bot"]).alias("recently_done"), px.is_stale(day, now, 30).alias("stale"), px.has_drifted(F.date_format("updated", "yyyy-MM-dd"), F.lit("1997-06-01")).alias("drifted"), px.haystack("Urgent ", col("status"), col("scope"), col("priority")).alias("found"), px.mentions_any(["BOT", "team"], col("scope"), col("assignee")).alias("people"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id IN (3, 5) OR (strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-12' AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2))""")
def seed_selection(spark, sf_dir):
    """Named seeds, and rows inside a window of ISO days whose key has two kinds or more."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    many = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("k")).where("k >= 2").select("user_id", F.lit(True).alias("many"))
    return e.join(many, "user_id", "left").where(F.col("event_id").isin(3, 5) | (F.col("day").between("2024-01-05", "2024-01-12") & F.col("many"))).select("event_id", "day")


_STAMP = "CASE doc_id % 3 WHEN 0 THEN '2024-03-0' || (doc_id % 9 + 1) || 'T10:00:00Z' WHEN 1 THEN '2024-03-0' || (doc_id % 9 + 1) ELSE 'later' END"


@query(f"SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 3 < 2 THEN doc_id % 9 + 1 >= 5 ELSE true END")
def since_filter(spark, sf_dir):
    """Times that cannot be read are compared as text."""
    return table(spark, sf_dir, "documents").where(px.since(F.expr(_STAMP), "2024-03-05")).select("doc_id")


@query("""SELECT CASE WHEN n_chars >= 2000 AND contains(text, '|') THEN 'uncertain' WHEN n_chars >= 2000 THEN 'excluded' ELSE 'backfill' END AS class, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def three_way_class(spark, sf_dir):
    c = F.when((F.col("n_chars") >= 2000) & F.contains("text", F.lit("|")), "uncertain").when(F.col("n_chars") >= 2000, "excluded").otherwise("backfill")
    return table(spark, sf_dir, "documents").groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'no_label' END, CASE WHEN l.quality = 0 THEN 'low_quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END) AS blocked, l.doc_id IS NOT NULL AND coalesce(l.quality, 1) <> 0 AND coalesce(l.toxic, 0) <> 1 AS eligible FROM documents d LEFT JOIN labels l USING (doc_id)""")
def eligibility(spark, sf_dir):
    """Eligible rows, and all the reasons that block the others."""
    l = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left")
    why = fx.failing(no_label=F.col("there").isNull(), low_quality=F.col("quality") == 0, toxic=F.col("toxic") == 1)
    return d.select("doc_id", F.concat_ws(",", why).alias("blocked"), (F.size(why) == 0).alias("eligible"))


@query("""SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS open_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' WHERE c_nationkey <> 3 GROUP BY 1""")
def archived_recount(spark, sf_dir):
    """Counts anew after archived projects (here one nation) are left out."""
    c = table(spark, sf_dir, "customer").where("c_nationkey <> 3").select("c_custkey", "c_mktsegment")
    n = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return c.join(n, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("open_orders"))


@query("""SELECT d.doc_id, least(1.0, greatest(0.0, e.value / 100)) AS confidence, e.event_type AS decision FROM documents d JOIN (SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')) e ON e.event_id = d.doc_id""")
def triage_validation(spark, sf_dir):
    """Decisions on known ids with a known verdict, their confidence within 0 and 1."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase")).select(F.col("event_id").alias("doc_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("confidence"), F.col("event_type").alias("decision"))
    return table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, CASE WHEN l.doc_id IS NULL THEN 'undecided' ELSE 'decided' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def decision_lookup(spark, sf_dir):
    l = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.when(F.col("there").isNull(), "undecided").otherwise("decided").alias("state"))


@query("""SELECT o_orderkey, count(l_partkey) AS lines, array_to_string(list(l_partkey ORDER BY l_partkey, l_quantity) FILTER (l_partkey IS NOT NULL), ',') AS parts, coalesce(sum(l_quantity), 0)::DOUBLE AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def grouped_children(spark, sf_dir):
    """One-to-many lookup: the ordered children of each row, also of rows without any."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("x"), F.sum("l_quantity").alias("q"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey", "left")
    parts = F.array_join(F.transform("x", lambda r: r["l_partkey"].cast("string")), ",")
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"), parts.alias("parts"), F.coalesce(F.col("q").cast("double"), F.lit(0.0)).alias("quantity"))


_COMMENTS_SQL = """SELECT user_id * 100 + l AS comment_id, md5(max(value)::VARCHAR) AS content_hash, max(event_id) % 7 = 0 AS human_edited, CASE WHEN max(event_id) % 5 = 0 THEN 'withdrawn' ELSE 'active' END AS lifecycle_state, CASE max(event_id) % 6 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'open' END AS finding_state, count(*) AS replies
 FROM (SELECT *, length(event_type) AS l FROM events) WHERE {0} GROUP BY 1"""


def _comments(events):
    last = F.max("event_id")
    k = (F.col("user_id") * 100 + F.length("event_type")).alias("comment_id")
    return events.groupBy(k).agg(F.md5(F.max("value").cast("string")).alias("content_hash"), (last % 7 == 0).alias("human_edited"), F.when(last % 5 == 0, "withdrawn").otherwise("active").alias("lifecycle_state"), F.when(last % 6 == 0, "withdrawn").when(last % 6 == 1, "open").alias("finding_state"), F.count("*").alias("replies"))


@query(f"""WITH b AS ({_COMMENTS_SQL.format("event_id % 2 = 0")}), a AS ({_COMMENTS_SQL.format("event_id % 2 = 1 OR value > 50")}),
j AS (SELECT coalesce(a.comment_id, b.comment_id) AS comment_id, b.comment_id IS NULL AS fresh, a.comment_id IS NULL AS lost, b.lifecycle_state = 'withdrawn' OR coalesce(b.finding_state, '') = 'withdrawn' AS bw, a.lifecycle_state = 'withdrawn' OR coalesce(a.finding_state, '') = 'withdrawn' AS aw,
 a.content_hash <> b.content_hash OR a.human_edited <> b.human_edited AS other, a.lifecycle_state <> b.lifecycle_state OR a.finding_state IS DISTINCT FROM b.finding_state AS moved, a.replies <> b.replies AS replied FROM b FULL JOIN a USING (comment_id))
SELECT comment_id, 'added' AS change FROM j WHERE fresh UNION ALL SELECT comment_id, 'withdrawn' FROM j WHERE lost OR (NOT fresh AND NOT bw AND aw) UNION ALL SELECT comment_id, 'restored' FROM j WHERE NOT fresh AND NOT lost AND bw AND NOT aw
UNION ALL SELECT comment_id, 'edited' FROM j WHERE NOT fresh AND NOT lost AND (other OR (moved AND bw = aw)) UNION ALL SELECT comment_id, 'replied' FROM j WHERE NOT fresh AND NOT lost AND replied""")
def comment_changes(spark, sf_dir):
    """Two snapshots of comments; a comment may have several changes at once."""
    e = table(spark, sf_dir, "events")
    return review.comment_delta(_comments(e.where("event_id % 2 = 0")), _comments(e.where("event_id % 2 = 1 or value > 50")), "comment_id")


@query("""SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN l_quantity >= 1 AND l_quantity < 11 THEN 'a' WHEN l_quantity < 26 THEN 'b' WHEN l_quantity < 46 THEN 'c' END AS band FROM lineitem""")
def range_containment(spark, sf_dir):
    """Which section [start, stop) an offset lies in; a few sections, so the range join is broadcast."""
    bands = spark.sql("SELECT * FROM VALUES (1, 11, 'a'), (11, 26, 'b'), (26, 46, 'c') AS b(start, stop, band)")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return joins.within_ranges(l, bands, F.col("l_quantity"), "start", "stop").select("l_orderkey", "l_partkey", "l_quantity", "band")


@query("""SELECT n_nationkey AS node, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_name) END AS only_neighbour, count(DISTINCT s_suppkey) AS neighbours FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def unique_neighbour(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.min("s_name").alias("one"), F.count_distinct("s_suppkey").alias("k"))
    j = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")).join(n, "node", "left")
    return j.select("node", F.when(F.col("k") == 1, F.col("one")).alias("only_neighbour"), F.coalesce("k", F.lit(0)).alias("neighbours"))


@query(f"""WITH a AS (SELECT doc_id AS id, md5({TEXT}) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id - 1 AS id, md5({TEXT}) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL AND (a.id IS NULL OR a.id % 10 = 4) THEN 'repaired' ELSE 'current' END AS side, CASE WHEN b.id IS NOT NULL AND (a.id IS NULL OR a.id % 10 = 4) THEN b.h ELSE a.h END AS h FROM a FULL JOIN b USING (id)""")
def overlay_merge(spark, sf_dir):
    """Per key the repaired row where the key is on the list or there is no other, else the current one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(fx.compact("text")).alias("h"))
    a, b = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("h").alias("a")), d.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("id"), F.col("h").alias("b"))
    j = a.join(b, "id", "full_outer")
    other = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("id") % 10 == 4))
    return j.select("id", F.when(other, "repaired").otherwise("current").alias("side"), F.when(other, F.col("b")).otherwise(F.col("a")).alias("h"))


@query("""WITH q AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 180)
SELECT event_id, user_id FROM q WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM b)""")
def queue_claim(spark, sf_dir):
    """The oldest queued job of each worker that has none active."""
    e = table(spark, sf_dir, "events")
    busy = e.where("event_type = 'error' and value > 180").select("user_id").distinct()
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.join(busy, "user_id", "left_anti").select("event_id", "user_id")


@query("""SELECT c_mktsegment AS segment, array_to_string(list(n_name || ':' || n ORDER BY n DESC, n_name)[1:3], ';') AS top FROM (SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1""")
def top_per_group(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = c.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))
    best = n.withColumn("rn", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "n_name"))).where("rn <= 3")
    said = F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", "n_name", "n").alias("s"))))
    return best.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.array_join(F.transform(said, lambda x: x["s"]), ";").alias("top"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1 ORDER BY 1 DESC")
def year_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_distinct("o_custkey").alias("customers")).orderBy(F.desc("year"))


@query("""SELECT k.label AS event_label, count(*) FILTER (CASE k.label WHEN 'course' THEN contains(lower(text), 'the') WHEN 'field' THEN contains(lower(text), 'de') ELSE NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'de') END) AS n FROM documents, (VALUES ('course'), ('field'), ('other')) k(label) GROUP BY 1""")
def label_counts(spark, sf_dir):
    """A row can have both labels; other has neither."""
    t = F.lower("text")
    a, b = F.contains(t, F.lit("the")), F.contains(t, F.lit("de"))
    return report.bucket_counts(table(spark, sf_dir, "documents"), {"course": a, "field": b, "other": ~a & ~b}).withColumnRenamed("bucket", "event_label")


@query(f"""WITH c AS ({_CARD}) SELECT coalesce(nullif(trim(assignee), ''), 'unassigned') AS member, count(*) AS total, count(*) FILTER (lower(status) = 'todo') AS doing, count(*) FILTER (lower(status) = 'done') AS done FROM c GROUP BY 1""")
def team_progress(spark, sf_dir):
    s = px.plain(F.col("status"))
    return report.share_by_member(cards(spark, sf_dir), F.coalesce(F.nullif(F.trim("assignee"), F.lit("")), F.lit("unassigned")), "member", doing=s == "todo", done=s == "done")


@query(f"""WITH c AS ({_CARD}), n AS (SELECT coalesce(nullif(trim(assignee), ''), 'unassigned') AS actor, count(*) AS n FROM c GROUP BY 1) SELECT actor, n, row_number() OVER (ORDER BY n DESC, actor)::INTEGER AS place FROM n""")
def groups_by_size(spark, sf_dir):
    """Groups, largest first, then by name. The ranking is over as many rows as there are members."""
    n = report.counts_by(cards(spark, sf_dir), F.coalesce(F.nullif(F.trim("assignee"), F.lit("")), F.lit("unassigned")), "actor")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "actor")))


@query(f"""WITH c AS ({_CARD}) SELECT * FROM (SELECT 'ready' AS posture, count(*) FILTER (lower(status) = 'todo' AND coalesce(scope, '') <> 'backstage') AS n FROM c UNION ALL SELECT 'blocked', count(*) FILTER (lower(status) = 'blocked') FROM c UNION ALL SELECT 'review', count(*) FILTER (lower(status) = 'review') FROM c UNION ALL SELECT 'done', count(*) FILTER (lower(status) = 'done') FROM c)""")
def posture_counts(spark, sf_dir):
    s = px.plain(F.col("status"))
    return report.bucket_counts(cards(spark, sf_dir), {"ready": (s == "todo") & (px.plain(F.col("scope")) != "backstage"), "blocked": s == "blocked", "review": s == "review", "done": s == "done"}).withColumnRenamed("bucket", "posture")


@query("""SELECT r.route, count(d.route) AS n FROM (VALUES ('text'), ('ocr'), ('blank'), ('image')) r(route) LEFT JOIN (SELECT CASE WHEN length(trim(text)) = 0 THEN 'blank' WHEN length(text) < 300 THEN 'ocr' ELSE 'text' END AS route FROM documents) d ON d.route = r.route GROUP BY 1""")
def page_routes(spark, sf_dir):
    """Routes of pages by what text they have, with zeros."""
    t = F.col("text")
    return report.counts_by(table(spark, sf_dir, "documents"), F.when(F.length(F.trim(t)) == 0, "blank").when(F.length(t) < 300, "ocr").otherwise("text"), "route", ["text", "ocr", "blank", "image"])


@query("""WITH i AS (SELECT DISTINCT user_id AS page, event_type || event_id % 10 AS issue, CASE event_type WHEN 'error' THEN 'red' WHEN 'signup' THEN 'yellow' ELSE 'green' END AS severity, value > 190 AS decided FROM events)
SELECT page, CASE min(CASE severity WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END) WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END AS status, count(DISTINCT issue) AS issues, count(DISTINCT issue) FILTER (severity = 'red') AS red FROM i WHERE NOT decided GROUP BY 1""")
def page_status(spark, sf_dir):
    """A page's status is its worst open issue; issues that come twice count once."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    i = e.select(F.col("user_id").alias("page"), F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("issue"), F.when(t == "error", 0).when(t == "signup", 1).otherwise(2).alias("rank"), (F.col("value") > 190).alias("decided")).where("not decided").distinct()
    out = i.groupBy("page").agg(F.min("rank").alias("worst"), F.count_distinct("issue").alias("issues"), F.count_distinct(F.when(F.col("rank") == 0, F.col("issue"))).alias("red"))
    return out.select("page", F.element_at(F.array(F.lit("red"), F.lit("yellow"), F.lit("green")), F.col("worst") + 1).alias("status"), "issues", "red")


@query("SELECT o_orderpriority AS category, median(o_totalprice) AS mid, count(*) FILTER (o_totalprice < 50000) AS collapsed, count(*) AS n FROM orders WHERE isfinite(o_totalprice) GROUP BY 1")
def medians(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(~F.isnan("o_totalprice"))
    return o.groupBy(F.col("o_orderpriority").alias("category")).agg(F.median("o_totalprice").alias("mid"), F.count_if(F.col("o_totalprice") < 50000).alias("collapsed"), F.count("*").alias("n"))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS section, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2), t AS (SELECT o_custkey, sum(n) AS total, max(n) AS most FROM v GROUP BY 1)
SELECT o_custkey, CASE WHEN 2 * most > total THEN (SELECT min(section) FROM v WHERE v.o_custkey = t.o_custkey AND v.n = t.most) END AS section, most::BIGINT AS votes, total::BIGINT AS total FROM t""")
def majority_vote(spark, sf_dir):
    """The section that has more than half of a key's votes, or none."""
    v = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey", F.col("o_orderpriority").alias("section")).agg(F.count("*").alias("n"))
    t = v.groupBy("o_custkey").agg(F.sum("n").alias("total"), F.max("n").alias("votes"), F.min_by("section", F.struct(-F.col("n"), "section")).alias("best"))
    return t.select("o_custkey", F.when(2 * F.col("votes") > F.col("total"), F.col("best")).alias("section"), "votes", "total")


_ITEMS_SQL = "SELECT o_custkey AS page, o_orderkey AS item, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'layout' END AS family, CASE WHEN o_orderkey % 50 = 7 THEN 'no diagnosis' WHEN o_orderkey % 50 = 9 THEN 'tried before' END AS blocked FROM orders"


def _plans(spark, sf_dir):
    k = F.col("o_orderkey")
    reasons = F.when(k % 50 == 7, F.array(F.lit("no diagnosis"))).when(k % 50 == 9, F.array(F.lit("tried before")))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("item"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("layout").alias("family"), reasons.alias("blocked"))
    return review.preflight(items, "page", "item", "family", "blocked", "item")


_PLANS_SQL = f"""i AS ({_ITEMS_SQL}), p AS (SELECT page, list(DISTINCT family ORDER BY family) AS f, list(item ORDER BY item) AS items, list(blocked ORDER BY item) FILTER (blocked IS NOT NULL) AS b FROM i GROUP BY page),
 r AS (SELECT page, CASE WHEN len(f) = 1 THEN f[1] END AS family, array_to_string(items, ',') AS keys, len(items)::INTEGER AS source_count,
 list_concat(CASE WHEN b IS NULL THEN [] WHEN list_contains(b, 'no diagnosis') AND list_contains(b, 'tried before') THEN CASE WHEN b[1] = 'no diagnosis' THEN ['no diagnosis', 'tried before'] ELSE ['tried before', 'no diagnosis'] END ELSE [b[1]] END, CASE WHEN len(f) > 1 THEN ['families that do not go together: ' || array_to_string(f, ', ')] ELSE [] END) AS reasons FROM p)"""


@query(f"WITH {_PLANS_SQL} SELECT page, family, keys, source_count, CASE WHEN len(reasons) > 0 THEN 'blocked' ELSE 'ready' END AS status, array_to_string(reasons, ';') AS reasons FROM r")
def preflight(spark, sf_dir):
    """Repair items by page: pages of several families, or with a blocked item, are not ready."""
    return _plans(spark, sf_dir).select("page", "family", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"), "source_count", "status", F.array_join("blocked_reasons", ";").alias("reasons"))


@query(f"WITH {_PLANS_SQL} SELECT count(*) FILTER (len(reasons) = 0) AS ready_pages, count(*) FILTER (len(reasons) > 0) AS blocked_pages, count(*) FILTER (len(reasons) = 0) <= 12 AS budget_ok FROM r")
def preflight_totals(spark, sf_dir):
    return review.preflight_totals(_plans(spark, sf_dir))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '10.1/' || doc_id % 30 END AS doi, regexp_replace(lower(left({TEXT}, 40)), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM documents), k AS (SELECT doc_id, coalesce('doi:' || doi, 'title:' || t) AS key FROM d)
SELECT key, min(doc_id) AS doc_id FROM k GROUP BY 1""")
def title_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 5 = 0 THEN '10.1/' || doc_id % 30 END").alias("doi"), F.left(fx.compact("text"), F.lit(40)).alias("title"))
    return dedup.duplicate_titles(d, "doi", "title", "doc_id").select("key", "doc_id")


@query("""SELECT l_partkey AS fact, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first_order, bool_or(l_returnflag = 'R') AS conflict, array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR)), ',') AS sources FROM lineitem GROUP BY 1""")
def merged_facts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fact"), F.struct("l_orderkey", "l_linenumber").alias("at"), (F.col("l_returnflag") == "R").alias("conflict"), F.col("l_suppkey").cast("string").alias("sources"))
    return dedup.merged_facts(l, "fact", "at", "conflict", "sources").select("fact", F.col("at.l_orderkey").alias("first_order"), "conflict", F.concat_ws(",", "sources").alias("sources"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) > 1 AS repeated FROM lineitem""")
def batch_repeats(spark, sf_dir):
    """The second and later occurrences of a signature in a batch."""
    w = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) > 1).alias("repeated"))


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 4 WHEN 'error' THEN 8 ELSE 0 END""")
def type_quota(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return dedup.by_type_quota(e, "event_type", {"click": 10, "view": 4, "error": 8}, F.desc("value"), "event_id").select("event_id", "event_type")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS place, CASE o_orderstatus WHEN 'P' THEN 'decide' WHEN 'O' THEN 'continue' ELSE 'archive' END AS action FROM orders""")
def board_order(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey")
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"), F.when(s == "P", "decide").when(s == "O", "continue").otherwise("archive").alias("action"))


@query("""SELECT l_suppkey, count(*) AS uses, max(l_orderkey) AS newest FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 ORDER BY uses DESC, newest DESC, l_suppkey LIMIT 4""")
def most_used(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_suppkey").agg(F.count("*").alias("uses"), F.max("l_orderkey").alias("newest"))
    return l.orderBy(F.desc("uses"), F.desc("newest"), "l_suppkey").limit(4)


@query("""WITH n AS (SELECT c_custkey, count(o_orderkey) AS active FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' WHERE c_acctbal > 0 GROUP BY 1) SELECT c_custkey, active FROM n ORDER BY active DESC, c_custkey LIMIT 1""")
def default_project(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("k", F.lit(0)).alias("active")).orderBy(F.desc("active"), "c_custkey").limit(1)


@query("""WITH g AS (SELECT doc_id AS id, 'generated' AS layer, n_chars AS v FROM documents WHERE n_chars > 300), m AS (SELECT doc_id AS id, 'manual' AS layer, quality::BIGINT AS v FROM labels)
SELECT * FROM g UNION ALL SELECT * FROM m WHERE id NOT IN (SELECT id FROM g)""")
def layer_union(spark, sf_dir):
    """Generated rows win over manual ones with the same id."""
    g = table(spark, sf_dir, "documents").where("n_chars > 300").select(F.col("doc_id").alias("id"), F.lit("generated").alias("layer"), F.col("n_chars").alias("v"))
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("manual").alias("layer"), F.col("quality").cast("long").alias("v"))
    return g.unionByName(m.join(g.select("id"), "id", "left_anti").select("id", "layer", "v"))


@query("""SELECT d, 'both' AS side FROM (SELECT o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT d, 'missing' FROM (SELECT o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'F')""")
def date_sets(spark, sf_dir):
    day = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.to_date("o_orderdate").alias("d"))
    f, p = day("F"), day("P")
    return f.intersect(p).withColumn("side", F.lit("both")).unionByName(p.subtract(f).withColumn("side", F.lit("missing")))


@query(f"""SELECT doc_id, CASE WHEN length(t) > 40 THEN rtrim(left(t, 39)) || '...' ELSE t END AS short, left(regexp_replace(regexp_replace(lower(t), '[^a-z0-9_.-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 80) AS slug, 'doc-' || left(sha256('{{"key":"' || doc_id || '"}}'), 16) AS stable_id,
 CASE doc_id % 4 WHEN 0 THEN 12000 WHEN 1 THEN 3000 WHEN 2 THEN 1024 ELSE 0 END AS likes, CASE doc_id % 3 WHEN 0 THEN '1,3,4,5' WHEN 1 THEN '7' ELSE '' END AS pages FROM (SELECT doc_id, {NORM.format(c="text")} AS t FROM documents)""")
def text_helpers(spark, sf_dir):
    """Ellipsis, slug, stable id, counts with units, page ranges."""
    likes = F.expr("CASE doc_id % 4 WHEN 0 THEN '1.2万' WHEN 1 THEN '3k' WHEN 2 THEN '1,024' ELSE 'none' END")
    pages = F.expr("CASE doc_id % 3 WHEN 0 THEN '3-5, 1' WHEN 1 THEN '7' ELSE 'x' END")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fx.short("text", 40).alias("short"), fx.slug("text").alias("slug"), F.concat(F.lit("doc-"), F.left(F.sha2(fx.canonical(key=F.col("doc_id").cast("string")), 256), F.lit(16))).alias("stable_id"), fx.parse_count(likes).cast("int").alias("likes"), F.concat_ws(",", fx.page_range(pages).cast("array<string>")).alias("pages"))


@query("""SELECT conv_id, turn, strpos(text, 'the') AS at, CASE WHEN k = 0 THEN 'missing' WHEN k = 1 THEN 'unique' ELSE 'ambiguous' END AS anchor, k AS found FROM (SELECT conv_id, turn, text, ((length(text) - length(replace(text, 'the', ''))) // 3)::INTEGER AS k FROM conversations)""")
def quote_anchor(spark, sf_dir):
    """Where a quote stands, and whether it stands there only."""
    t = F.col("text")
    k = ((F.length(t) - F.length(F.replace(t, F.lit("the"), F.lit("")))) / 3).cast("int")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.instr(t, F.lit("the")).alias("at"), F.when(k == 0, "missing").when(k == 1, "unique").otherwise("ambiguous").alias("anchor"), k.alias("found"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 3)) AS w FROM documents), b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 3)) AS w FROM benchmark),
x AS (SELECT item_id, len(w) AS n, unnest(w) AS tok FROM b), y AS (SELECT doc_id, unnest(w) AS tok FROM t), s AS (SELECT item_id, doc_id, n, count(*) AS shared FROM x JOIN y USING (tok) GROUP BY ALL), g AS (SELECT *, max(shared) OVER (PARTITION BY item_id) AS most FROM s WHERE 2 * shared >= n)
SELECT item_id, doc_id, shared FROM g WHERE shared = most""")
def overlap_locate(spark, sf_dir):
    """The documents that share most of a passage's words, at least half of them, all ties: an
    equi-join on words with counts, not a comparison of all pairs."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 3))
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("tok"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("tok"))
    s = b.join(d, "tok").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.first("n").alias("n")).where("2 * shared >= n")
    most = s.groupBy("item_id").agg(F.max("shared").alias("most"))
    return s.join(most, "item_id").where("shared = most").select("item_id", "doc_id", "shared")


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS p, l_orderkey + 1 AS c FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 5 <> 0), r AS (SELECT p AS root, c AS node, 1 AS hops FROM e UNION ALL SELECT r.root, e.c, r.hops + 1 FROM r JOIN e ON e.p = r.node) SELECT DISTINCT root, node, hops::INTEGER AS hops FROM r""")
def descendant_closure(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_linenumber = 2 and l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("p"), (F.col("l_orderkey") + 1).alias("c"))
    return graph.descendants(e, "p", "c")


@query("""WITH r AS (SELECT event_id, user_id AS src, event_id % 40 AS dst, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS rank FROM events), n AS (SELECT DISTINCT user_id AS node FROM events), b AS (SELECT src, dst, max(rank) AS best FROM r GROUP BY 1, 2)
SELECT event_id, src, dst, rank, CASE WHEN dst NOT IN (SELECT node FROM n) THEN 'missing_endpoint' WHEN rank < best THEN 'weaker' ELSE 'valid' END AS verdict FROM r JOIN b USING (src, dst)""")
def relation_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select("event_id", F.col("user_id").alias("src"), (F.col("event_id") % 40).alias("dst"), F.expr("CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END").alias("rank"))
    return graph.relation_audit(r, e.select(F.col("user_id").alias("node")), "event_id", "src", "dst", "rank")


@query("""WITH b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), a AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_linenumber > 2) SELECT l_orderkey, l_linenumber FROM a LEFT JOIN b USING (k) WHERE rn > coalesce(n, 0)""")
def surplus_violations(spark, sf_dir):
    """New violations beyond as many of the same key as the baseline had."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    b = l.where("l_linenumber <= 2").groupBy("l_partkey").agg(F.count("*").alias("n"))
    a = l.where("l_linenumber > 2").withColumn("rn", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")))
    return a.join(b, "l_partkey", "left").where(F.col("rn") > F.coalesce("n", F.lit(0))).select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id, strftime(to_timestamp(1700000000 + doc_id * 3600), '%Y-%m-%d') AS day, (doc_id % 3 * 3600 + doc_id % 50 * 60 + 5)::INTEGER AS seconds, CASE WHEN doc_id % 12 = 0 THEN 12 ELSE doc_id % 12 END::INTEGER AS hour FROM documents""")
def times(spark, sf_dir):
    """Epochs in seconds or milliseconds, durations and 12-hour clocks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("(1700000000 + doc_id * 3600) * CASE WHEN doc_id % 2 = 0 THEN 1000 ELSE 1 END").alias("epoch"), F.expr("concat(doc_id % 3, 'h ', doc_id % 50, 'm 5s')").alias("took"), F.expr("concat(CASE WHEN doc_id % 12 = 0 THEN '下午' ELSE '上午' END, CASE WHEN doc_id % 12 = 0 THEN 12 ELSE doc_id % 12 END, ':00')").alias("clock"))
    return d.select("doc_id", F.date_format(fx.from_epoch(F.col("epoch")), "yyyy-MM-dd").alias("day"), fx.duration_seconds(F.col("took")).alias("seconds"), fx.clock_hour(F.col("clock")).alias("hour"))
