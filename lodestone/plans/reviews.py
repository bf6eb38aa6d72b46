"""Queries on review ledgers: attention, gates, spines, repeats, sequences, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import predicates as px
from lodestone.operators import review
from lodestone.plans.catalogue import query, table

_ISSUES = """SELECT user_id, event_type || '-' || event_id % 5 AS issue, event_id, CASE WHEN value > 150 THEN 'hard_blocker' WHEN value > 60 THEN 'needs_review' ELSE 'tip' END AS impact,
 CASE WHEN event_id % 11 = 0 THEN 'ignored' WHEN event_id % 13 = 0 THEN 'accepted' END AS decision FROM events"""
_ATTENTION = f"""WITH i AS ({_ISSUES}), f AS (SELECT user_id, issue, arg_min(impact, event_id) AS impact, arg_min(coalesce(decision, 'pending'), event_id) AS decision FROM i GROUP BY 1, 2),
p AS (SELECT user_id, count(*) FILTER (impact <> 'tip' AND decision <> 'ignored') AS actionable, count(*) FILTER (impact = 'hard_blocker' AND decision <> 'ignored') AS hard_blocker, count(*) FILTER (impact = 'needs_review' AND decision <> 'ignored') AS needs_review,
 count(*) FILTER (impact = 'tip') AS tip, count(*) FILTER (impact <> 'tip' AND decision = 'ignored') AS ignored FROM f GROUP BY 1)"""


def _issues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    impact = F.when(F.col("value") > 150, "hard_blocker").when(F.col("value") > 60, "needs_review").otherwise("tip")
    decision = F.when(F.col("event_id") % 11 == 0, "ignored").when(F.col("event_id") % 13 == 0, "accepted")
    return e.select("user_id", F.concat_ws("-", "event_type", F.col("event_id") % 5).alias("issue"), "event_id", impact.alias("impact"), decision.alias("decision"))


@query(_ATTENTION + " SELECT * FROM p")
def attention_pages(spark, sf_dir):
    return review.attention(_issues(spark, sf_dir), "user_id", "issue", "event_id", "impact", "decision")


@query(_ATTENTION + """ SELECT sum(actionable)::BIGINT AS actionable_issues, sum(hard_blocker)::BIGINT AS hard_blocker_issues, sum(needs_review)::BIGINT AS needs_review_issues, sum(tip)::BIGINT AS tip_issues, sum(ignored)::BIGINT AS ignored_issues,
 count(*) FILTER (actionable > 0) AS actionable_pages, count(*) FILTER (hard_blocker > 0) AS hard_blocker_pages, count(*) FILTER (needs_review > 0) AS needs_review_pages, count(*) FILTER (tip > 0) AS tip_pages FROM p""")
def attention_summary(spark, sf_dir):
    return review.attention_totals(attention_pages(spark, sf_dir))


@query("""WITH k AS (SELECT o_custkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS hit FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT count(*) AS known, count(*) FILTER (hit) AS detected, count(*) FILTER (NOT hit) AS missed, round(count(*) FILTER (hit) / count(*), 4) AS page_recall FROM k""")
def baseline_recall(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return review.page_recall(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), o.where("o_orderstatus = 'P'"), "o_custkey")


@query("""WITH r AS (SELECT event_type, user_id, CASE WHEN max(value) > 190 THEN 'red' ELSE 'pass' END AS status, count(*) AS issues FROM events WHERE value > 30 GROUP BY 1, 2),
h AS (SELECT event_type, user_id, count(*) AS reviews FROM events WHERE value <= 30 GROUP BY 1, 2), e AS (SELECT event_type, max(user_id) AS last FROM r GROUP BY 1 HAVING max(user_id) >= 1),
s AS (SELECT event_type, unnest(range(1, last + 1)) AS user_id FROM e)
SELECT event_type, user_id, coalesce(status, 'pass') AS status, coalesce(issues, 0) AS issues, coalesce(reviews, 0) AS reviews FROM s LEFT JOIN r USING (event_type, user_id) LEFT JOIN h USING (event_type, user_id)""")
def page_spine(spark, sf_dir):
    e, key = table(spark, sf_dir, "events"), ["event_type", "user_id"]
    report = e.where("value > 30").groupBy(key).agg(F.when(F.max("value") > 190, "red").otherwise("pass").alias("status"), F.count("*").alias("issues"))
    human = e.where("value <= 30").groupBy(key).agg(F.count("*").alias("reviews"))
    return review.page_spine(report, *key, human).na.fill({"status": "pass", "issues": 0, "reviews": 0})


_EARLY = "ts < TIMESTAMP '2024-01-16'"


@query(f"""WITH b AS (SELECT DISTINCT user_id FROM events WHERE {_EARLY} AND value > 120), a AS (SELECT DISTINCT user_id FROM events WHERE NOT ({_EARLY}) AND value > 120),
n AS (SELECT (SELECT count(*) FROM b) AS red_before, (SELECT count(*) FROM a) AS red_after, (SELECT count(*) FROM a ANTI JOIN b USING (user_id)) AS new_red, EXISTS (SELECT 1 FROM a WHERE user_id = 3) AS target_red)
SELECT *, CASE WHEN target_red OR new_red > 0 THEN 'fail' ELSE 'pass' END AS gate FROM n""")
def red_page_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("red", F.col("value") > 120)
    return review.red_page_gate(e.where(_EARLY), e.where(f"NOT ({_EARLY})"), "user_id", "red", F.col("user_id") == 3)


@query("""WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'F')
SELECT (SELECT count(*) FROM a ANTI JOIN b USING (o_custkey)) AS added, (SELECT count(*) FROM b ANTI JOIN a USING (o_custkey)) AS removed, (SELECT count(*) FROM b) AS before, (SELECT count(*) FROM a) AS after""")
def refresh_delta(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return review.id_delta(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_custkey")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_linestatus = 'F')
SELECT o_orderkey AS l_orderkey, l_shipdate, l_linenumber, l_partkey FROM orders LEFT JOIN l ON o_orderkey = l_orderkey AND rn = 1""")
def latest_review(spark, sf_dir):
    order = F.struct("l_shipdate", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey"))
    comments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return review.latest_for(comments, table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F", order, ["l_shipdate", "l_linenumber", "l_partkey"])


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value > 100 THEN props ELSE '' END AS summary, event_type AS source FROM events),
s AS (SELECT user_id, source, min(event_id) AS since FROM e GROUP BY 1, 2), j AS (SELECT user_id, list(source ORDER BY since) AS names FROM s GROUP BY 1)
SELECT user_id, arg_min(ts, event_id) AS ts, coalesce(arg_min(summary, event_id) FILTER (summary <> ''), '') AS summary, any_value(list_reduce(names, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ', ' || x END)) AS source FROM e JOIN j USING (user_id) GROUP BY 1""")
def merged_repeats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("value") > 100, F.col("props")).otherwise("").alias("summary"), F.col("event_type").alias("source"))
    return review.merged_repeats(e, "user_id", "event_id", ["ts"], "summary", "source")


@query("""WITH c AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 6 = 0 THEN ' ' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'skipped' ELSE 'odd' END AS status FROM orders WHERE o_totalprice > 50000),
k AS (SELECT o_orderpriority, CASE WHEN status = ' ' THEN 'pending' WHEN status = 'odd' THEN 'failed' ELSE status END AS s FROM c)
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed FROM k GROUP BY 1""")
def summary_status_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 6 == 0, " ").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "skipped").otherwise("odd")
    return review.status_counts(o.withColumn("status", status), "o_orderpriority", "status", F.col("o_totalprice") > 50000)


@query("""SELECT event_type, coalesce(nullif(trim(CASE WHEN value > 150 THEN ' sent' WHEN value > 100 THEN '  ' WHEN value > 50 THEN 'held' END), ''), 'unknown') AS verdict, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1, 2""")
def verdict_histogram(spark, sf_dir):
    v = F.when(F.col("value") > 150, " sent").when(F.col("value") > 100, "  ").when(F.col("value") > 50, "held")
    return table(spark, sf_dir, "events").groupBy("event_type", F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit("unknown")).alias("verdict")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS updated, CASE o_orderkey % 3 WHEN 0 THEN '1996-06-01T09:00' WHEN 1 THEN '' END AS landed FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey, coalesce(left(landed, 10), '') = '' OR updated > left(landed, 10) AS stale, coalesce(nullif(left(landed, 10), ''), updated) AS day FROM t""")
def landing_order(spark, sf_dir):
    """Pages that have a landing page: those behind their card first, then by day, newest first."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    landed = F.left(F.when(F.col("o_orderkey") % 3 == 0, "1996-06-01T09:00").when(F.col("o_orderkey") % 3 == 1, ""), F.lit(10))
    updated, day = F.date_format("o_orderdate", "yyyy-MM-dd"), F.nullif(landed, F.lit(""))
    rows = o.select("o_orderkey", (day.isNull() | (updated > day)).alias("stale"), F.coalesce(day, updated).alias("day"))
    return rows.orderBy(F.desc("stale"), F.desc("day"), "o_orderkey")


_NAME = "l_returnflag || CASE l_linenumber % 4 WHEN 0 THEN '-' || l_orderkey || '_card.md' WHEN 1 THEN '-' || l_orderkey || '.md' WHEN 2 THEN '-' || (l_orderkey + 1000000) || '.txt' ELSE '-x' || l_orderkey || '.md' END"


@query("""WITH u AS (SELECT l_returnflag, max(l_orderkey) FILTER (l_linenumber % 4 < 2) AS used FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT l_returnflag, CASE l_returnflag WHEN 'A' THEN 99999999 WHEN 'N' THEN -5 END AS counter FROM lineitem)
SELECT l_returnflag, greatest(coalesce(counter, 0), coalesce(used, 0), 0) + 1 AS next FROM c LEFT JOIN u USING (l_returnflag)""")
def next_sequence(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(_NAME).alias("name"))
    counters = names.select("l_returnflag").distinct().withColumn("counter", F.expr("CASE l_returnflag WHEN 'A' THEN 99999999 WHEN 'N' THEN -5 END"))
    return review.next_numbers(names, counters, "l_returnflag", "name", "counter")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN '{"page":' || l_orderkey || ',"region":[' || CASE WHEN l_linenumber = 1 THEN '' ELSE (round_even(l_quantity / 8, 0) * 8)::BIGINT || ',' || (round_even(l_partkey / 8, 0) * 8)::BIGINT || ',' || (round_even(l_suppkey / 8, 0) * 8)::BIGINT || ',' || (round_even(l_quantity * 2 / 8, 0) * 8)::BIGINT END || '],"type":"' || l_returnflag || '"}' END AS signature FROM lineitem""")
def region_signatures(spark, sf_dir):
    x = lambda c: F.col(c).cast("double")
    region = F.when(F.col("l_linenumber") == 1, F.array(x("l_quantity"))).otherwise(F.array(x("l_quantity"), x("l_partkey"), x("l_suppkey"), x("l_quantity") * 2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", review.region_signature(F.col("l_orderkey"), F.col("l_returnflag"), region, ["A", "R"]).alias("signature"))


@query("""SELECT doc_id FROM documents WHERE CASE WHEN n_chars > 2000 THEN 'must_read' ELSE 'skim' END = 'skim' AND contains(lower(concat_ws(' ', text, source, lang)), 'the')""")
def site_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where((F.when(F.col("n_chars") > 2000, "must_read").otherwise("skim") == "skim") & px.haystack("the", F.col("text"), F.col("source"), F.col("lang"))).select("doc_id")


@query("""WITH c AS (SELECT conv_id, count(DISTINCT turn) AS versions, count(*) FILTER (role <> 'system' AND coalesce(text, '') <> '') AS live, max(turn) AS last FROM conversations GROUP BY 1) SELECT * FROM c""")
def document_menu(spark, sf_dir):
    """A line for each document: its versions, live comments and last activity, the last active first."""
    c = table(spark, sf_dir, "conversations")
    live = F.count_if((F.col("role") != "system") & (F.coalesce("text", F.lit("")) != ""))
    return c.groupBy("conv_id").agg(F.count_distinct("turn").alias("versions"), live.alias("live"), F.max("turn").alias("last")).orderBy(F.desc("last"), F.desc("conv_id"))


_TYPES = ("signup", "purchase", "view")


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE event_type END AS type FROM events)
SELECT type, coalesce(list_position({list(_TYPES)}, type)::INTEGER - 1, 99)::BIGINT AS place, count(*) AS n, min(event_id) AS first FROM e GROUP BY type""")
def nodes_by_type(spark, sf_dir):
    """Types with their place in a list (99 outside it), in this order, then by name."""
    kind = F.coalesce(F.nullif(F.trim(F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type"))), F.lit("")), F.lit("unknown"))
    n = table(spark, sf_dir, "events").groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    place = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("type"))
    return n.withColumn("place", F.when(place > 0, place - 1).otherwise(99)).orderBy("place", "type")


@query("""WITH p AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS due_at, o_orderpriority AS action FROM orders), f AS (SELECT l_orderkey AS o_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'no_progress' WHEN 'R' THEN 'handled' ELSE 'seen' END AS outcome, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS nxt, ' n' || l_partkey || ' ' AS note FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM f)
SELECT o_orderkey, CASE WHEN outcome = 'no_progress' AND nxt IS NOT NULL THEN nxt ELSE due_at END AS due_at, CASE WHEN outcome = 'handled' THEN 'no_action' ELSE action END AS action, CASE WHEN outcome = 'handled' THEN trim(note) END AS reason, outcome FROM p LEFT JOIN (SELECT * FROM l WHERE rn = 1) USING (o_orderkey)""")
def feedback_patch(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("due_at"), F.col("o_orderpriority").alias("action"))
    flag = F.col("l_returnflag")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.when(flag == "A", "no_progress").when(flag == "R", "handled").otherwise("seen").alias("outcome"), F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("nxt"), F.concat(F.lit(" n"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("note"))
    return review.latest_feedback(p, f, "o_orderkey", "at", "outcome", "nxt", "note")


@query("""WITH c AS (SELECT o_custkey AS k, max(o_orderkey % 4) AS revision, 'old' AS question, 'todo' AS status, 'open' AS state FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), d AS (SELECT o_custkey AS k, o_orderkey % 5 AS revision, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS question, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 170000), b AS (SELECT k, c.k IS NOT NULL AS card, coalesce(d.revision >= coalesce(c.revision, 0), false) AS taken, c.revision AS r0, d.revision AS r1, c.question AS q0, d.question AS q1, c.status, c.state FROM c FULL JOIN (SELECT * FROM d WHERE rn = 1) d USING (k))
SELECT k, CASE WHEN taken THEN r1 ELSE r0 END AS revision, CASE WHEN taken THEN coalesce(q1, k::VARCHAR) ELSE q0 END AS question, CASE WHEN s.k IS NOT NULL THEN 'done' WHEN taken THEN 'review' ELSE status END AS status, CASE WHEN s.k IS NOT NULL THEN 'auto_closed' WHEN taken THEN 'pending' ELSE state END AS state FROM b LEFT JOIN s USING (k)""")
def reconcile_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    cards = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.max(F.col("o_orderkey") % 4).alias("revision")).withColumns({"question": F.lit("old"), "status": F.lit("todo"), "state": F.lit("open")})
    decisions = o.where("o_orderstatus = 'O'").select("k", (F.col("o_orderkey") % 5).alias("revision"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("question"), "o_orderkey")
    return review.reconciled(cards, decisions, o.where("o_totalprice > 170000").select("k"), "k", "o_orderkey")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, count(*) AS n, bool_or(l_returnflag = 'A') AS blocked FROM lineitem GROUP BY 1, 2), q AS (SELECT o_orderkey AS l_orderkey, 1 + o_orderkey % 3 AS l_linenumber, 1 + (o_orderkey % 50 = 0)::INTEGER AS k FROM orders WHERE o_orderpriority <> '5-LOW'),
b AS (SELECT coalesce(o.l_orderkey, q.l_orderkey) AS l_orderkey, n, k, blocked FROM o FULL JOIN q ON o.l_orderkey = q.l_orderkey AND o.l_linenumber = q.l_linenumber)
SELECT l_orderkey, coalesce(sum(k), 0)::BIGINT AS asked, CASE WHEN sum(k) IS NULL OR bool_or(coalesce(k > 1, false) OR coalesce(n > 1, false) OR n IS NULL) THEN 'operation_ids_conflict' WHEN bool_or(k IS NOT NULL AND blocked) THEN 'blocked_operation' ELSE 'ok' END AS code FROM b GROUP BY 1""")
def accepted_operations(spark, sf_dir):
    operations = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_returnflag") == "A", "blocked").otherwise("update").alias("action"))
    asked = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_orderkey") % 3).alias("l_linenumber"), F.explode(F.sequence(F.lit(1), F.when(F.col("o_orderkey") % 50 == 0, 2).otherwise(1))).alias("copy"))
    return review.acceptance(operations, asked, "l_orderkey", "l_linenumber", "action")


@query("""WITH a AS (SELECT event_id, 'attempt-' || left(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 16) AS attempt_id FROM events), f AS (SELECT attempt_id, min(event_id) AS f FROM a GROUP BY 1)
SELECT event_id, attempt_id, CASE WHEN f < event_id THEN f END AS first_order FROM a JOIN f USING (attempt_id)""")
def attempt_guard(spark, sf_dir):
    return review.reused_attempts(table(spark, sf_dir, "events"), "event_id", ["user_id", "event_type"]).select("event_id", "attempt_id", "first_order")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderpriority IS NOT NULL AND o_custkey % 9 = 0)")
def changed_rows(spark, sf_dir):
    was = table(spark, sf_dir, "orders").withColumn("selected", F.lit(True))
    now = was.withColumn("selected", F.col("o_orderkey") % 2 == 0).withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderpriority", F.when(F.col("o_custkey") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")))
    return review.changed_ids(was, now, "o_orderkey", ["selected"])


@query("""WITH a AS (SELECT user_id, event_id, event_type = 'signup' AS s1, value >= 60 AS g1, event_type = 'error' AS s2, value < 120 AS g2, value > 170 AS cells, value > 130 AND event_type = 'view' AS dense, value < 90 AS short FROM events),
b AS (SELECT *, sum((s1 OR NOT g1)::INTEGER) OVER w AS n1 FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), c AS (SELECT *, coalesce(first_value(s1) OVER (PARTITION BY user_id, n1 ORDER BY event_id), false) AND n1 > 0 AS nav FROM b),
d AS (SELECT *, sum(((NOT nav AND s2) OR nav OR NOT g2)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS n2 FROM c), e AS (SELECT *, first_value(NOT nav AND s2) OVER (PARTITION BY user_id, n2 ORDER BY event_id) AND n2 > 0 AS acr FROM d),
f AS (SELECT *, NOT nav AND NOT acr AND NOT cells AND dense AS whole, NOT nav AND NOT acr AND NOT cells AND short AS stays FROM e), g AS (SELECT *, sum((whole OR NOT stays)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS n3 FROM f), h AS (SELECT *, first_value(whole) OVER (PARTITION BY user_id, n3 ORDER BY event_id) AND n3 > 0 AS goes FROM g)
SELECT user_id, event_id, CASE WHEN nav THEN 'navigation' WHEN acr THEN 'acronym' WHEN cells THEN 'cell_table' WHEN whole THEN 'dense_table' WHEN goes THEN 'dense_table_continuation' ELSE 'narrative' END AS type FROM h""")
def page_types(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    marks = {"navigation": (t == "signup", v >= 60), "acronym": (t == "error", v < 120)}
    return review.page_types(table(spark, sf_dir, "events"), "user_id", "event_id", marks, v > 170, (v > 130) & (t == "view"), v < 90).select("user_id", "event_id", "type")


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 340 END::BIGINT AS x, (row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) - 1) * 170 AS y FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)""")
def flow_layout(spark, sf_dir):
    """Each conversation's turns in two columns of its own."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    user = F.when(F.col("role") == "user", 0).otherwise(1)
    return review.placed(c, user, "turn", within=["conv_id"]).select("conv_id", "turn", "x", "y")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10024) || chr(128135) AS t FROM documents)
SELECT doc_id, ((2 * length(t) - (length(t) - length(regexp_replace(t, '[\\x00-\\x7F]+', '', 'g'))) + 2 * (length(t) - length(regexp_replace(t, '[\\x{10000}-\\x{10FFFF}]+', '', 'g'))) + 1) // 2)::BIGINT AS width FROM d""")
def title_width(spark, sf_dir):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit("✨\U0001f487"))
    return table(spark, sf_dir, "documents").select("doc_id", review.width_of_title(t).alias("width"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x0, l_quantity + l_linenumber * 4 AS x1, l_tax * 100 AS y0, l_tax * 100 + 5 AS y1, 20.0 AS u0, 40.0 AS u1, 2.0 AS v0, 6.0 AS v1 FROM lineitem),
s AS (SELECT *, greatest(0, least(x1, u1) - greatest(x0, u0)) AS across, greatest(0, least(y1, v1) - greatest(y0, v0)) AS down FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(across * down / greatest(1, least((x1 - x0) * (y1 - y0), 80)), 6) AS area, round(across / greatest(1, least(x1 - x0, 20)), 6) AS width, greatest(0, least(1, coalesce(try_cast(CASE WHEN l_linenumber = 2 THEN 'much' ELSE ((x0 - 10) / 20)::VARCHAR END AS DOUBLE), 0))) AS confidence FROM s""")
def box_overlaps(spark, sf_dir):
    q, y = F.col("l_quantity"), F.col("l_tax") * 100
    area, width = review.overlap((q, y, q + F.col("l_linenumber") * 4, y + 5), tuple(map(F.lit, (20.0, 2.0, 40.0, 6.0))))
    sure = F.when(F.col("l_linenumber") == 2, "much").otherwise(((q - 10) / 20).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(area, 6).alias("area"), F.round(width, 6).alias("width"), review.clamped(sure).alias("confidence"))
