"""Readers for the record files of a curation run. All are lazy scans; paths may be globs or folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROKEN = "_corrupt"


def is_object(line: Column) -> Column:
    """Whether a line is one JSON object and nothing else. It is parsed inside brackets and inside braces:
    text after the object that would pass in one is an error in the other, and a second value counts.
    Names in single quotes, which Spark's parser lets pass, are errors too; so is NaN."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"', "")
    one = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    closed = F.json_object_keys(F.concat(F.lit('{"x":'), line, F.lit("}"))).isNotNull()
    return F.coalesce(line.rlike(r"^\s*\{") & one & closed & ~F.contains(bare, F.lit("'")), F.lit(False))


def _whole(rows: DataFrame, schema: str, mode: str) -> DataFrame:
    """Rows with `value` as objects of the schema, in one of the modes of `jsonl`."""
    rows = rows.where(F.trim(F.regexp_replace("value", r"[\s\x{FEFF}]+", " ")) != "").withColumn("__ok", is_object(F.col("value")))
    if mode == "strict":
        said = F.concat(F.lit("not a JSON object in "), F.col("path"), F.lit(": "), F.left("value", F.lit(80)))
        rows = rows.where(F.when(F.col("__ok"), True).otherwise(F.raise_error(said).cast("boolean")))
    elif mode == "permissive":
        rows = rows.where("__ok")
    return rows.withColumn("__o", F.when(F.col("__ok"), F.from_json("value", schema)))


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """One JSON object a line; blank lines are skipped. strict: another line, also a list of objects or an
    object with something after it, is an error when it is read. permissive: such lines are left out.
    counted: they stay, with nulls and the line itself in the column _corrupt, so that they can be
    counted. A field of another type is null."""
    rows = _whole(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"), schema, mode)
    return rows.select("__o.*", *([F.when(~F.col("__ok"), F.col("value")).alias(BROKEN)] if mode == "counted" else []))


def jsonl_findings(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The objects, with _line, and the audit findings (path, line_no, problem) of the other lines."""
    rows = _whole(lines(spark, path), schema, "counted")
    problem = F.when(F.try_parse_json("value").isNull() | F.col("value").rlike(r"^\s*\{"), "invalid JSON").otherwise("not an object")
    return rows.where("__ok").select("__o.*", F.col("line_no").alias("_line")), rows.where("not __ok").select("path", "line_no", problem.alias("problem"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) with physical line numbers from 1, blank lines counted. A file may be read
    in several splits: lines are numbered inside their split, and the lines of earlier splits of the
    file are added, which are a row for each split."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    first = raw.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = first.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return raw.join(before, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of `jsonl` with _line, their physical line number; other values are left out."""
    return _whole(lines(spark, path), schema, "permissive").select("__o.*", F.col("line_no").alias("_line"))


def json_export(spark: SparkSession, path: str, fields: dict[str, list[str]]) -> DataFrame:
    """Files that hold a list of records, or an object with the list `records`; a record's `fields`
    object stands for the record. Each output column takes the first of its aliases that is there;
    records that are no objects are left out. Also (file, at): the record's place."""
    v = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("file"), F.try_parse_json("value").alias("v"))
    records = F.coalesce(F.try_variant_get("v", "$.records", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    r = v.select("file", F.posexplode(records).alias("at", "r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    r = r.withColumn("r", F.coalesce(F.try_variant_get("r", "$.fields", "variant"), F.col("r")))
    return r.select("file", "at", *(F.coalesce(*(F.try_variant_get("r", f"$.{a}", "string") for a in aliases)).alias(c) for c, aliases in fields.items()))


def records_by_suffix(spark: SparkSession, path: str, schema: str, tag: str | None = None) -> DataFrame:
    """A CSV file with a header (with or without a byte order mark; quoted fields may hold newlines and
    doubled quotation marks, so a file is read by one task), or else JSON lines; with `tag` an array
    column `tags` that begins with it."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path) if path.lower().endswith(".csv") else jsonl(spark, path, schema)
    if tag is None:
        return rows
    have = F.split(F.coalesce("tags", F.lit("")), "[;,|]") if "tags" in rows.columns else F.array().cast("array<string>")
    return rows.withColumn("tags", F.concat(F.array(F.lit(tag)), F.filter(F.transform(have, lambda t: F.trim(t)), lambda t: t != "")))


def frontmatter(text: Column) -> Column:
    """map<string, string> of the `key: value` lines between the first two lines `---`; empty without. Of
    lines with the same key the last one counts."""
    head = F.regexp_extract(text, r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)), r"^([\"'])(.*)\1$", "$2").alias("v")))
    keys = F.transform(entries, lambda e: e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"])))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """(path, meta, body) of the Markdown files below a folder; names below it that begin with a dot are
    left out, whatever the folder itself is called."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getRawPath().rstrip("/")
    below = F.substr(F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z0-9+.-]+:(?://[^/]*)?", ""), F.lit(len(top) + 1))
    raw = raw.select(F.col("_metadata.file_path").alias("path"), "value", below.alias("below")).where(~F.col("below").rlike(r"/\.[^/]"))
    body = F.regexp_replace("value", r"(?s)\A\x{FEFF}?---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    return raw.select("path", frontmatter(F.col("value")).alias("meta"), body.alias("body"))


def csv_union(spark: SparkSession, paths: list[str], route: str = "route", leave_out: str = "review") -> DataFrame:
    """CSV files with different columns as one table, by name; rows on the route to leave out go."""
    out = None
    for p in paths:
        rows = spark.read.options(header=True, multiLine=True, escape='"').csv(p).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.where(~F.coalesce(F.col(route) == leave_out, F.lit(False))) if route in out.columns else out
