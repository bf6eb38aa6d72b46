"""Sinks: idempotent appends, writes that check a version, and one pass into several outputs."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.joins import parts


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def event_id(*parts: Column) -> Column:
    """A stable id from what makes an event the same event."""
    return F.concat(F.lit("ev-"), F.left(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), F.lit(24)))


def append_events(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the ledger does not have; of rows with the same key one. Running it
    again with the same rows adds nothing. One writer at a time, as for any append-only ledger. Rows and
    ledger are dealt by key to as many parts as their numbers need before anything is sorted: a file's
    split may hold many rows that take few bytes. The rows are counted first, so they are read twice."""
    spark = rows.sparkSession
    ledger = spark.read.parquet(path).select(key) if exists(spark, path) else None
    n = max(parts(d) for d in (rows, ledger) if d is not None)
    fresh = rows.repartition(n, key).dropDuplicates([key])
    if ledger is not None:
        fresh = fresh.join(ledger.repartition(n, key).hint("merge"), key, "left_anti").select(rows.columns)
    fresh.write.mode("append").parquet(path)


def current_version(spark: SparkSession, path: str) -> int:
    """The number of the latest whole version, 0 if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0
    names = [s.getPath() for s in fs.listStatus(p)]
    return max([int(n.getName()[2:]) for n in names if n.getName().startswith("v=") and fs.exists(n.suffix("/_SUCCESS"))], default=0)


def write_version(rows: DataFrame, path: str, expected: int) -> int:
    """Write the next version if `expected` is the current one, else an error. The version is written
    aside, in a folder of this writer alone. Of writers that expect the same version the one that makes
    the claim file of the next version goes on, also where renames of folders are not atomic, and the
    others fail. A writer that fails gives its claim back; the claim of one that was killed must be deleted."""
    spark = rows.sparkSession
    if (found := current_version(spark, path)) != expected:
        raise ValueError(f"version {found} where {expected} was expected")
    aside, target, claim = f"{path}/.next-{uuid.uuid4().hex}", f"{path}/v={expected + 1}", f"{path}/.claim-{expected + 1}"
    fs, c = _fs(spark, claim)
    try:
        fs.create(c, False).close()
    except Py4JJavaError as e:
        raise ValueError(f"version {expected + 1} is written by someone else") from e
    try:
        if current_version(spark, path) != expected:
            raise ValueError(f"version {expected + 1} was written by someone else")
        rows.write.parquet(aside)
        if not fs.rename(_fs(spark, aside)[1], _fs(spark, target)[1]):
            raise ValueError(f"version {expected + 1} could not be put in its place")
    except Exception:
        delete(spark, aside)
        raise
    finally:
        fs.delete(c, False)
    return expected + 1


def digest(rows: DataFrame) -> str:
    """A digest of the rows in any order."""
    one = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return "-".join(str(x) for x in one)


def write_if_changed(rows: DataFrame, path: str) -> bool:
    """Write a new version if the rows differ from the current one's; whether it did."""
    spark = rows.sparkSession
    at = current_version(spark, path)
    if at and digest(spark.read.parquet(f"{path}/v={at}")) == digest(rows):
        return False
    write_version(rows, path, at)
    return True


def project_known(rows: DataFrame, known: list[str], read_only: list[str]) -> DataFrame:
    """Only the columns that a target knows and lets be written, in its order."""
    return rows.select([c for c in known if c in rows.columns and c not in read_only])


def fan_out(rows: DataFrame, path: str, kind: str) -> None:
    """One pass over the rows into a folder for each kind, with a manifest of counts beside them."""
    rows.write.mode("overwrite").partitionBy(kind).parquet(f"{path}/items")
    spark = rows.sparkSession
    spark.read.parquet(f"{path}/items").groupBy(kind).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
