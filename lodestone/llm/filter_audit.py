"""What each filter of a chain removes, in every order of the chain.

Documents are reduced to cells: a part (language) and the set of filters that a document fails, as a
bit mask, with counts. Cells are unpivoted against the steps of all orders; a running bit-or over the
steps before tells which filter had removed a cell's documents, and sums over the cells give the
figures of each step. A window over a part's and filter's rows sums what the filter removes in all
orders.

The masks take one pass over the texts. Equal texts are found by SHA-256: one row a text with its
smallest id goes back to the texts that occur more than once, as a join that adaptive execution may
split. What follows has at most 32 cells a part.

Defined results: a null text counts as empty; a null language and an empty one are the same part; each
row of a repeated document counts; a document without an id neither repeats a text nor is repeated,
and has no label; of several labels of an id the largest values count; an empty table has no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import settle

#: The filters by name, in the order of their bits.
FILTERS = "ABCDE"
SPACES = "\t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The maximal runs of characters other than the blank and 0x09-0x0D."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def failures(docs: DataFrame, id_col: str, text: str, min_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 3, symbols: str = r"[#$%&*|]") -> DataFrame:
    """`docs` without its text, with the mask of filters A to E that each row fails: few words, few
    distinct words, many capitals, a symbol, a text that a smaller id has."""
    t = F.coalesce(text, F.lit(""))
    base = docs.withColumn("__text", t).withColumn("__words", words(F.col("__text")))
    n, chars = F.size("__words"), F.length("__text")
    capitals = chars - F.length(F.translate("__text", CAPITALS, ""))
    tests = (n < min_words, F.size(F.array_distinct("__words")) * 100 < n * distinct_percent, capitals * 100 > chars * capitals_percent, F.col("__text").rlike(symbols))
    mask = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))
    base = base.withColumns({"__mask": mask, "__content": F.unhex(F.sha2("__text", 256))}).drop("__words", "__text", text)
    base = settle(base, "masks")
    first = base.where(F.col(id_col).isNotNull()).groupBy("__content").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    first = settle(first, "first-ids")  # read anew, so that the join below deals both sides and can split a text with many copies
    repeats = F.coalesce(F.col(id_col) > F.col("__first"), F.lit(False))
    return base.join(first, "__content", "left").withColumn("__mask", F.col("__mask") + F.when(repeats, 16).otherwise(0)).drop("__content", "__first")


def cells(failed: DataFrame, labels: DataFrame, id_col: str, part: str) -> DataFrame:
    """Counts of documents, good ones and toxic ones by part and mask."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("__good"), F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"))
    rows = failed.select(F.col(id_col).alias("__id"), F.coalesce(part, F.lit("")).alias("part"), F.col("__mask").alias("mask"))
    counted = rows.where("__id is not null").groupBy("__id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "__id", "left")
    counted = counted.select("part", "mask", "n", *(F.coalesce(F.col(f"__{m}"), F.lit(0)).alias(m) for m in ("good", "toxic")))
    unnamed = rows.where("__id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return counted.unionByName(unnamed).groupBy("part", "mask").agg(*sums)


def by_order(cell: DataFrame) -> DataFrame:
    """The figures of each step of each order, from the cells."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = cell.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("at", "filter"))
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)")
    steps = steps.withColumn("bit", bit).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    fails, gone = F.col("hit") != 0, F.col("earlier") != 0

    def total(test: Column, of: str = "n") -> Column:
        return F.sum(F.when(test, F.col(of)).otherwise(0)).cast("long")

    figures = {
        "kept": total(~fails & ~gone), "removed": total(fails & ~gone), "redundant": total(fails & gone), "unique_fails": total(F.col("mask") == F.col("bit")),
        "good_lost": total(fails & ~gone, "good"), "toxic_lost": total(fails & ~gone, "toxic"),
    }
    made = steps.groupBy("part", "filter_order", "at", "filter").agg(*(c.alias(k) for k, c in figures.items()))
    made = made.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return made.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), *figures, "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang", **thresholds) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    plain = docs.select(id_col, text, part)
    return by_order(settle(cells(failures(plain, id_col, text, **thresholds), labels, id_col, part), "cells"))
