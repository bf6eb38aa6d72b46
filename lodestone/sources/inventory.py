"""Inventories of files: listings without content, digests of what has changed, ledgers against manifests.

A listing reads no content. The driver holds the paths of whatever is scanned, as for any read of files;
digests are made in tasks, a file in one piece, so files are below 2 GB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "path string, size long, mtime timestamp"
KNOWN = f"{LISTED}, sha256 string"


def _files(spark: SparkSession, paths: str | list[str], glob: str):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)


def _with_empty(files: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` of the files and those of the empty ones, which Spark leaves out of a scan: they are among
    the paths that it found. Their time is null."""
    paths = [(p,) for p in files.inputFiles()]
    path = F.url_decode(F.replace("p", F.lit("+"), F.lit("%2B")))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    known = files.sparkSession.createDataFrame(paths, "p string").select(bare(path).alias("path"))
    empty = known.join(rows.select(bare(F.col("path")).alias("path")), "path", "left_anti")
    fill = {"size": F.lit(0).cast("long"), "mtime": F.lit(None).cast("timestamp"), "sha256": F.sha2(F.lit(""), 256)}
    return rows.unionByName(empty.select("path", *(fill[c].alias(c) for c in rows.columns[1:])))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime) of all files below a folder; names that begin with a dot or an underscore are
    left out, as by all readers."""
    files = _files(spark, folder, glob)
    return _with_empty(files, files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))


def digests(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """(path, size, mtime, sha256)."""
    files = _files(spark, paths, glob)
    return _with_empty(files, files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256")))


def inventory(files: DataFrame) -> DataFrame:
    """`files` (path, sha256 and more) with format (the suffix in small letters, '' without), date_hint (the
    first day of the form 20xx-xx-xx in the path, '' without) and duplicate_of, the first path that has
    the same content, if it is another one."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    first = files.groupBy("sha256").agg(F.min("path").alias("__first"))
    rows = files.join(first, "sha256").withColumn("duplicate_of", F.when(F.col("__first") != F.col("path"), F.col("__first"))).drop("__first")
    return rows.withColumns({"format": F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)), "date_hint": F.regexp_extract("path", r"(?<![0-9])(20[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])", 1)})


def refresh(spark: SparkSession, folder: str, known: DataFrame, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """The inventory as it is now, and (path, change, was) against the known one: added, changed, touched
    (new time or size, same content), removed, or renamed (`was`, the first path that is gone and had
    this content). Only files whose size or time differ from what is known are read."""
    now = listing(spark, folder, glob)
    held = known.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("sha256").alias("__sha"))
    met = now.join(held, "path", "left")
    same = F.coalesce((F.col("size") == F.col("__size")) & F.col("mtime").eqNullSafe(F.col("__mtime")) & F.col("__size").isNotNull(), F.lit(False))
    todo = [r.path for r in met.where(~same).select("path").collect()]
    # a path is a pattern to a reader, so what has a meaning in patterns is escaped
    read = digests(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in todo]) if todo else spark.createDataFrame([], KNOWN)
    after = met.where(same).select("path", "size", "mtime", F.col("__sha").alias("sha256")).unionByName(read)
    gone = held.join(now.select("path"), "path", "left_anti").groupBy(F.col("__sha").alias("sha256")).agg(F.min("path").alias("was"))
    new = read.join(held, "path", "left").join(gone, "sha256", "left")
    change = F.when(F.col("__sha").isNotNull(), F.when(F.col("__sha") == F.col("sha256"), "touched").otherwise("changed")).when(F.col("was").isNotNull(), "renamed").otherwise("added")
    removed = held.join(now.select("path"), "path", "left_anti").select("path", F.lit("removed").alias("change"), F.lit(None).cast("string").alias("was"))
    return after, new.select("path", change.alias("change"), F.when(change == "renamed", F.col("was")).alias("was")).unionByName(removed)


def ledger_faults(spark: SparkSession, folder: str, manifest: DataFrame, name: Column, glob: str = "*") -> DataFrame:
    """(name, fault, expected, found): every file that is missing or in no manifest row (extra), of another
    digest (sha256), or with another number of lines that are not blank (row_count). `manifest` has name,
    sha256 and row_count, whose nulls ask for nothing; `name` is a column of the path. A name that two
    rows or two files have is a fault too (repeated)."""
    files = digests(spark, folder, glob).withColumn("name", name)
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    counts = text.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").groupBy(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path")).agg(F.count("*").alias("lines")).withColumn("name", name)
    counts = counts.groupBy("name").agg(F.sum("lines").alias("lines"))
    have = files.groupBy("name").agg(F.count("*").alias("files"), F.min("sha256").alias("found_sha")).join(counts, "name", "left")
    asked = manifest.groupBy("name").agg(F.count("*").alias("rows"), F.min("sha256").alias("want_sha"), F.min("row_count").alias("want_rows"))
    both = asked.join(have, "name", "full_outer")
    here, wanted, lines = F.col("files").isNotNull(), F.col("rows").isNotNull(), F.coalesce("lines", F.lit(0))
    fault = lambda test, n, want, got: F.when(test, F.struct(F.lit(n).alias("fault"), want.cast("string").alias("expected"), got.cast("string").alias("found")))
    none = F.lit(None)
    found = [
        fault(wanted & ~here, "missing", F.lit("file"), none), fault(here & ~wanted, "extra", none, F.lit("file")), fault((F.col("rows") > 1) | (F.col("files") > 1), "repeated", F.lit(1), F.greatest("rows", "files")),
        fault(wanted & here & (F.lower("want_sha") != F.col("found_sha")), "sha256", F.col("want_sha"), F.col("found_sha")), fault(wanted & here & (F.col("want_rows") != lines), "row_count", F.col("want_rows"), lines),
    ]
    return both.select("name", F.explode(F.array_compact(F.array(*found))).alias("f")).select("name", "f.*")


def verified(spark: SparkSession, folder: str, manifest: DataFrame, name: Column, glob: str = "*") -> None:
    """An error that names the first faults of a ledger, if it has any."""
    if bad := ledger_faults(spark, folder, manifest, name, glob).orderBy("name", "fault").limit(5).collect():
        raise ValueError("; ".join(f"{x.name}: {x.fault}" for x in bad))
