"""Queries of the readers, sinks and streams. Each writes what it reads from the driver's tables into a new
folder below the shared one first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators.graph import shared_folder
from lodestone.plans.catalogue import TEXT, query, table
from lodestone.sources import files, inventory, sinks
from lodestone.streaming import folds


def folder(spark) -> str:
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


def written(spark, lines: DataFrame) -> str:
    """Rows (value) as text files."""
    path = folder(spark)
    lines.select("value").write.text(path)
    return path


_EVENT = "event_id long, user_id long, event_type string, value double"


def _event_lines(spark, sf_dir) -> str:
    """Events as JSON lines; one in ten is cut off or goes on after its end, one in eleven is a list, one in
    thirteen blank."""
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    k = F.col("event_id")
    return written(spark, e.select(F.when(k % 20 == 3, F.left(good, F.lit(20))).when(k % 20 == 13, F.concat(good, F.lit(" junk"))).when(k % 11 == 5, F.concat(F.lit("["), good, F.lit("]"))).when(k % 13 == 7, " ").otherwise(good).alias("value")))


_WHOLE = "event_id % 10 <> 3 AND event_id % 11 <> 5 AND event_id % 13 <> 7"


@query(f"SELECT event_id, user_id, event_type, value FROM events WHERE {_WHOLE}")
def jsonl_permissive(spark, sf_dir):
    return files.jsonl(spark, _event_lines(spark, sf_dir), _EVENT, "permissive")


@query("SELECT event_id, user_id, event_type, value FROM events")
def jsonl_strict(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.to_json(F.struct("event_id", "user_id", "event_type", "value")), F.when(F.col("event_id") % 4 == 0, "\n").otherwise("")).alias("value"))
    return files.jsonl(spark, written(spark, rows), _EVENT)


@query(f"SELECT count(*) FILTER ({_WHOLE}) AS events, count(*) FILTER (event_id % 10 = 3 OR event_id % 11 = 5) AS malformed, count(*) FILTER ({_WHOLE} AND event_type = 'click') AS clicks FROM events")
def jsonl_counted(spark, sf_dir):
    """Malformed lines are counted; the discriminator is looked at in whole ones only."""
    r, bad = files.jsonl(spark, _event_lines(spark, sf_dir), _EVENT, "counted"), F.col(files.BROKEN).isNotNull()
    return r.agg(F.count_if(~bad).alias("events"), F.count_if(bad).alias("malformed"), F.count_if(~bad & (F.col("event_type") == "click")).alias("clicks"))


@query("SELECT event_id, event_id * 2 + 1 AS line FROM events")
def jsonl_numbered(spark, sf_dir):
    """Physical line numbers: a blank line stands after each object, in one file in the order of ids."""
    path = folder(spark)
    e = table(spark, sf_dir, "events").repartition(1).sortWithinPartitions("event_id")
    e.select(F.concat(F.to_json(F.struct("event_id")), F.lit("\n"))).write.text(path)
    return files.numbered_jsonl(spark, path, "event_id long").select("event_id", F.col("_line").alias("line"))


@query(f"SELECT doc_id::VARCHAR AS upstream_id, left({TEXT}, 30) AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS tags FROM documents")
def json_export(spark, sf_dir):
    """A file per source: lists of records, or objects with `records` of which `fields` count."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.left(fx.compact("text"), F.lit(30)).alias("t"), "lang")
    flat = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("t").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("tags")))
    odd = F.pmod(F.xxhash64("source"), F.lit(2)) == 1
    one = F.when(odd, F.concat(F.lit('{"record_id": "r", "fields": '), flat, F.lit("}"))).otherwise(flat)
    whole = d.groupBy("source", odd.alias("odd")).agg(F.concat_ws(",", F.lit("7"), F.collect_list(one)).alias("x"))
    path = folder(spark)
    whole.select(F.when(F.col("odd"), F.concat(F.lit('{"records": ['), "x", F.lit("]}"))).otherwise(F.concat(F.lit("["), "x", F.lit("]"))).alias("value"), "source").write.partitionBy("source").text(path)
    return files.json_export(spark, f"{path}/*/*.txt", {"upstream_id": ["upstream_id", "id", "record_id"], "title": ["title", "name", "subject"], "tags": ["tags"]}).select("upstream_id", "title", "tags")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS headline, 'legacy|' || p_brand AS tags FROM part")
def csv_records(spark, sf_dir):
    """CSV with a byte order mark and a header, with a tag in front."""
    path = f"{folder(spark)}/x.csv"
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headline"), F.col("p_brand").alias("tags"))
    p.coalesce(1).write.option("header", True).csv(path)
    return files.records_by_suffix(spark, path, "", "legacy").select("id", "headline", F.concat_ws("|", "tags").alias("tags"))


@query("SELECT n_nationkey::VARCHAR AS task_id, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END AS human_gate, n_nationkey % 2 = 0 AS gated, 'Body of ' || n_name AS body FROM nation")
def card_scan(spark, sf_dir):
    """Cards of Markdown with frontmatter, one file each, also in folders; a dot folder is left out."""
    n = table(spark, sf_dir, "nation")
    text = F.format_string("---\ntitle: \"%s\"\ntask_id: %s\nhuman_gate: %s\n---\nBody of %s", "n_name", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "yes").otherwise("no"), "n_name")
    path = folder(spark)
    rows = n.select("n_nationkey", "n_name", text.alias("value"))
    names = rows.select("n_nationkey", "value").collect()  # the 25 rows of a fixture
    for k, (i, v) in enumerate(names):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{'a/b' if k % 2 else 'a'}/{i}.md")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(v.encode()))
        out.close()
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.git/x.md")
    hidden.getFileSystem(spark._jsc.hadoopConfiguration()).create(hidden, True).close()
    c = files.cards(spark, path)
    return c.select(F.col("meta")["task_id"].alias("task_id"), F.col("meta")["title"].alias("title"), F.col("meta")["human_gate"].alias("human_gate"), F.col("meta")["human_gate"].isin("1", "true", "yes", "on").alias("gated"), "body")


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS title, NULL::VARCHAR AS route FROM supplier UNION ALL SELECT p_partkey::VARCHAR, p_name, CASE WHEN p_size > 25 THEN 'main' END FROM part WHERE p_size > 25 OR p_size <= 10")
def csv_bucket_union(spark, sf_dir):
    """CSV buckets with different columns as one table, without the rows to review."""
    a, b = f"{folder(spark)}/main.csv", f"{folder(spark)}/supplement.csv"
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")).write.option("header", True).csv(a)
    table(spark, sf_dir, "part").select(F.expr("CASE WHEN p_size > 25 THEN 'main' WHEN p_size > 10 THEN 'review' END").alias("route"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title")).write.option("header", True).csv(b)
    return files.csv_union(spark, [a, b]).select("id", "title", "route")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, 2 AS version FROM events GROUP BY 1")
def ledger_appends(spark, sf_dir):
    """Events appended twice in overlapping parts are in the ledger once; the second write of the same
    summary makes no version, another does, and one that expects the wrong version fails."""
    path = folder(spark)
    e = table(spark, sf_dir, "events").withColumn("key", sinks.event_id(F.col("user_id"), F.col("event_id")))
    for part in (e.where("event_id % 3 < 2"), e.where("event_id % 3 > 0"), e):
        sinks.append_events(part, f"{path}/ledger", "key")
    n = spark.read.parquet(f"{path}/ledger").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
    wrote = [sinks.write_if_changed(x, f"{path}/summary") for x in (n.limit(0), n, n)]
    try:
        sinks.write_version(n, f"{path}/summary", 0)
        wrote.append(True)
    except ValueError:
        pass
    if wrote != [True, True, False]:
        raise AssertionError(wrote)
    at = sinks.current_version(spark, f"{path}/summary")
    return spark.read.parquet(f"{path}/summary/v={at}").withColumn("version", F.lit(at))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def fan_out(spark, sf_dir):
    path = folder(spark)
    sinks.fan_out(sinks.project_known(table(spark, sf_dir, "events"), ["event_id", "event_type", "value", "more"], ["value"]), path, "event_type")
    return spark.read.schema("event_type string, n long").json(f"{path}/manifest")


def _streamed(spark, rows: DataFrame, part, run) -> DataFrame:
    """What `run` makes of the rows as a stream of a batch for each part, in their order. A part's files,
    as many as tasks wrote, are read as one batch before the next part is written."""
    path, made = folder(spark), None
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(path)
        made = run(spark.readStream.schema(rows.schema).parquet(path))
    return made


@query("""WITH d AS (SELECT user_id AS item, least(2, day(ts) // 11)::INTEGER AS batch, sum(event_id)::BIGINT AS p FROM events GROUP BY 1, 2)
SELECT c.batch, c.item, CASE WHEN b.item IS NULL THEN 'new' WHEN b.p = c.p THEN 'seen' ELSE 'updated' END AS event FROM d c LEFT JOIN d b ON b.item = c.item AND b.batch = c.batch - 1""")
def stream_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), F.least(F.lit(2), F.expr("day(ts) div 11").cast("int")).alias("batch")).agg(F.sum("event_id").alias("p"))
    out = folder(spark)
    return _streamed(spark, e, F.col("batch"), lambda d: folds.changes(d.drop("batch"), out, "item", "p"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_event_sink(spark, sf_dir):
    """Events that arrive twice, in another batch, are in the ledger once."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    twice = e.withColumn("batch", (F.col("event_id") % 3).cast("int")).unionByName(e.withColumn("batch", F.lit(2)))
    out = folder(spark)
    return _streamed(spark, twice, F.col("batch"), lambda d: folds.event_sink(d.drop("batch"), out, "event_id"))


@query("""WITH w AS (SELECT user_id, date_trunc('hour', ts) AS hour, ts, event_id, event_type FROM events), b AS (SELECT user_id, hour, min((ts, event_id)) AS s FROM w WHERE event_type = 'signup' GROUP BY 1, 2),
t AS (SELECT w.user_id, w.hour, min((ts, event_id)) AS stop FROM w JOIN b ON b.user_id = w.user_id AND b.hour = w.hour AND (w.ts, w.event_id) >= b.s WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2)
SELECT w.user_id, strftime(w.hour, '%Y-%m-%d %H') AS hour, count(*)::INTEGER AS phases, arg_max(event_type, (ts, event_id)) AS last_phase, arg_min(event_id, (ts, event_id)) AS first_id FROM w JOIN b ON b.user_id = w.user_id AND b.hour = w.hour JOIN t ON t.user_id = w.user_id AND t.hour = w.hour WHERE (ts, event_id) >= s AND (ts, event_id) <= stop GROUP BY 1, 2""")
def stream_assembly(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = folder(spark)
    made = _streamed(spark, e, F.col("event_id") % 3, lambda d: folds.assembled(d, out, "user_id", "ts", "event_type", "event_id", "signup", ["purchase", "error"]))
    return made.select("user_id", F.date_format("window", "yyyy-MM-dd HH").alias("hour"), "phases", "last_phase", "first_id")


@query("""WITH d AS (SELECT least(2, day(ts) // 11)::INTEGER AS batch, user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE value > 60 GROUP BY 1, 2), p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY batch), []) AS was FROM d)
SELECT batch, user_id, array_to_string(list_filter(s, lambda x: NOT list_contains(was, x)), ',') AS added, array_to_string(list_filter(was, lambda x: NOT list_contains(s, x)), ',') AS removed FROM p""")
def stream_set_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 60").select("user_id", "event_type", F.least(F.lit(2), F.expr("day(ts) div 11").cast("int")).alias("batch"))
    out = folder(spark)
    made = _streamed(spark, e, F.col("batch"), lambda d: folds.set_changes(d.drop("batch"), out, "user_id", "event_type"))
    return made.select("batch", "user_id", F.concat_ws(",", "added").alias("added"), F.concat_ws(",", "removed").alias("removed"))


@query("""WITH d AS (SELECT source, count(*) AS n, sha256(string_agg('{"doc_id":' || doc_id || '}' || chr(10), '' ORDER BY doc_id)) AS sha, substr(source, 4)::INTEGER % 4 AS k FROM documents GROUP BY source)
SELECT source AS name, 'sha256' AS fault, 'no digest' AS expected, sha AS found FROM d WHERE k = 0 UNION ALL SELECT source, 'row_count', (n + 1)::VARCHAR, n::VARCHAR FROM d WHERE k = 1
UNION ALL SELECT source, 'extra', NULL, 'file' FROM d WHERE k = 2 UNION ALL SELECT 'gone', 'missing', 'file', NULL""")
def ledger_faults(spark, sf_dir):
    """A ledger file for each source, and a manifest that is wrong for three in four of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.to_json(F.struct("doc_id")).alias("value"))
    path = folder(spark)
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    k = F.substr("source", F.lit(4)).cast("int") % 4
    counted = docs.groupBy("source").agg(F.count("*").alias("n")).where(k != 2)
    names = F.regexp_extract("path", r"source=([^/]*)/", 1)
    right = inventory.digests(spark, path).select(names.alias("source"), F.col("sha256").alias("right"))
    rows = counted.join(right, "source").select(F.col("source").alias("name"), F.when(k == 0, "no digest").otherwise(F.col("right")).alias("sha256"), F.when(k == 1, F.col("n") + 1).otherwise(F.col("n")).alias("row_count"))
    gone = rows.limit(1).select(F.lit("gone").alias("name"), F.lit("x").alias("sha256"), F.lit(1).cast("long").alias("row_count"))
    return inventory.ledger_faults(spark, path, rows.unionByName(gone), names)


@query("""SELECT lang AS name, CASE lang WHEN 'de' THEN 'removed' WHEN 'en' THEN 'changed' WHEN 'fr' THEN 'renamed' ELSE 'added' END AS change FROM documents WHERE lang <> 'de' GROUP BY lang
UNION ALL SELECT 'de', 'removed' UNION ALL SELECT 'old', 'removed'""")
def file_refresh(spark, sf_dir):
    """A file for each language, and an inventory from before: one has changed, one has another name, one
    is gone, one is new."""
    docs = table(spark, sf_dir, "documents").where("lang <> 'de'").select("lang", F.to_json(F.struct("doc_id")).alias("value"))
    path = folder(spark)
    docs.repartition("lang").sortWithinPartitions("lang", "value").write.partitionBy("lang").text(path)
    now = inventory.digests(spark, path)
    lang = F.regexp_extract("path", r"lang=([^/]*)/", 1)
    before = now.where(lang.isin("en", "fr")).select(F.when(lang == "fr", F.regexp_replace("path", "lang=fr", "lang=old")).otherwise(F.col("path")).alias("path"), (F.col("size") + F.when(lang == "en", 1).otherwise(0)).alias("size"), "mtime", F.when(lang == "en", "other").otherwise(F.col("sha256")).alias("sha256"))
    gone = before.limit(1).select(F.lit(f"{path}/lang=de/part").alias("path"), "size", "mtime", F.lit("nowhere").alias("sha256"))
    return inventory.refresh(spark, path, before.unionByName(gone))[1].select(lang.alias("name"), "change")
