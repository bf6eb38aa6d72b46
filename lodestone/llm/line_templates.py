"""Line dedup with a log-template tree, in DataFrame operations only.

Each line of a text (cut at newlines) that is not blank is parsed down a tree of fixed depth: first by
its number of tokens (white space parts them), then by its first DEPTH tokens. A token with a digit
counts as a variable field `<*>` anywhere. In a leaf, a position at which more than MAX_CHILDREN
different tokens occur is a variable field too. The line has up to two templates, with and without the
variable fields of its leaf, of which those count that keep at least half of their tokens fixed.
Besides, each line stands for itself, literally.

A template, or a literal line, recurs if MIN_DOCS documents or more carry it, and all lines that recur
are dropped. Copies of a document count as one carrier: a document of which at least half of the other
different lines are in other documents too goes with those that have the same smallest hash among
these shared lines; any other document is a carrier of its own, and so is one without other lines.
So boilerplate recurs, and the lines that only a group of copies has in common are left to the
near-duplicate join, which keeps one of the group whole. (If boilerplate is half of the lines of all
its documents and they have nothing else in common, they look like copies, and it stays.)

Null texts stay null and empty texts empty; both have no dropped lines. Blank lines stay. Rows that
repeat an id, and rows with a null id, are told apart by their text; equal texts are one document and
equal rows share their result. Columns besides id and text are carried along by
`without_recurring_lines`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import drop, settle, tidy

DEPTH, MAX_CHILDREN, MIN_DOCS = 4, 8, 10
VARIABLE = "<*>"
#: White space within lines besides the space.
_WHITE = "\t\x0b\f\r"
#: Such white space, and runs of any; a token with a digit, tried only where a token begins.
_SPACES, _WITH_DIGIT = "[ \\t\\x0b\\f\\r]{2,}|[\\t\\x0b\\f\\r]", "(?<![^ \\n])[^ \\n0-9]*+[0-9][^ \\n]*+"


def _lines(docs: DataFrame, id_col: str, text: str, depth: int) -> DataFrame:
    """(id, content, line_no, line, hash, leaf) of the lines that are not blank; in `line` tokens are
    parted by one space and those with a digit replaced, `hash` is that of the line as it is. The whole
    text is rewritten before it is cut, as an expression over lines would be copied into each filter
    that Catalyst pushes down, and an inner explode would add filters that repeat what makes its array.
    The leaf takes no list of tokens: it is a hash of the number of spaces and of what stands before
    the space number `depth`."""
    uneven = reduce(or_, (F.contains(F.col(text), F.lit(x)) for x in ("  ", *_WHITE)))
    plain = F.regexp_replace(F.when(uneven, F.regexp_replace(F.col(text), _SPACES, " ")).otherwise(F.col(text)), _WITH_DIGIT, VARIABLE)
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), F.transform(F.split(F.col(text), "\n", -1), lambda x: F.xxhash64(x)).alias("hashes"), F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)).alias("lines"))
    d = d.select("id", "content", F.posexplode_outer(F.arrays_zip(F.col("hashes").alias("hash"), F.col("lines").alias("line"))).alias("line_no", "one"))
    line = F.col("one.line")
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return d.where(line != "").select("id", "content", "line_no", "one.line", "one.hash", F.xxhash64(spaces, F.substring_index(line, " ", depth)).alias("leaf"))


def _contents(rows: DataFrame, key: str, at_least: int) -> DataFrame:
    """(key, among): the keys in at least so many different contents."""
    return rows.groupBy(key, "content").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("*").alias("among")).where(F.col("among") >= at_least)


def _shared(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """held (hash, content, among): lines in several contents, with the number of these; about (content,
    n, m, least, next): the different lines of a content, how many of them are shared, and the least
    two hashes of the shared ones."""
    said = lines.groupBy("hash", "content").agg(F.lit(1).alias("one")).select("hash", "content")
    held = settle(said.join(_contents(lines, "hash", 2), "hash"), "held")
    two = held.groupBy("content").agg(F.count("*").alias("m"), F.slice(F.sort_array(F.collect_list("hash")), 1, 2).alias("two"))
    about = said.groupBy("content").agg(F.count("*").alias("n")).join(two, "content")
    return held, settle(about.select("content", "n", "m", F.get("two", F.lit(0)).alias("least"), F.get("two", F.lit(1)).alias("next")), "about")


def _carried(rows: DataFrame, about: DataFrame, key: str, min_docs: int) -> DataFrame:
    """The keys with enough carriers, from rows (key, content, hash, is_shared)."""
    others = F.col("m") - F.when(F.col("is_shared"), 1).otherwise(0)
    group = F.when(F.col("is_shared") & (F.col("hash") == F.col("least")), F.col("next")).otherwise(F.col("least"))
    carrier = F.when((2 * others < F.col("n") - 1) | (F.col("n") == 1), F.col("content")).otherwise(F.coalesce(group, "content"))
    told = rows.join(about, "content", "left").select(key, F.coalesce(carrier, "content").alias("carrier"))
    return told.groupBy(key, "carrier").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("*").alias("carriers")).where(F.col("carriers") >= min_docs).select(key)


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, max_children: int = MAX_CHILDREN, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, content, line_no, template): the lines to drop, with the template that recurs, null if the
    line recurs only literally. `content` is xxhash64 of the text."""
    lines = settle(_lines(docs, id_col, text, depth), "lines", "zstd")
    held, about = _shared(lines)
    literal = _carried(held.where(F.col("among") >= min_docs).select("hash", "content", F.lit(True).alias("is_shared")), about, "hash", min_docs)
    said = lines.select("id", "content", "line_no", "hash").join(literal, "hash", "left_semi")
    said = settle(said.select("id", "content", "line_no", F.lit(None).cast("string").alias("template")), "said")
    tidy(docs.sparkSession)
    near = lines.join(_contents(lines, "leaf", min_docs).select("leaf"), "leaf", "left_semi")
    near = settle(near.withColumn("tokens", F.split("line", " ")).drop("line"), "near", "zstd")
    drop(lines)
    tidy(docs.sparkSession)
    spots = near.where(F.size("tokens") > depth).select("leaf", F.posexplode("tokens").alias("at", "token")).where(f"at >= {depth}")
    loose = spots.groupBy("leaf", "at", "token").agg(F.lit(1).alias("one")).groupBy("leaf", "at").agg(F.count("*").alias("kinds")).where(F.col("kinds") > max_children).groupBy("leaf").agg(F.collect_set("at").alias("loose"))
    shaped = near.join(loose, "leaf", "left").withColumn("loose", F.coalesce("loose", F.array().cast("array<int>")))
    shaped = shaped.withColumn("shape", F.transform("tokens", lambda t, i: F.when(F.array_contains("loose", i), F.lit(VARIABLE)).otherwise(t)))
    template = lambda c: F.when(2 * F.size(F.filter(c, lambda t: t != VARIABLE)) >= F.size(c), F.concat_ws(" ", c))
    shaped = shaped.select("id", "content", "line_no", "hash", F.explode(F.array_distinct(F.array_compact(F.array(template("shape"), template("tokens"))))).alias("template"))
    shaped = settle(shaped.withColumn("key", F.xxhash64("template")), "shapes", "zstd")
    drop(near)
    often = shaped.join(_contents(shaped, "key", min_docs).select("key"), "key", "left_semi").select("key", "content", "hash").distinct()
    told = often.join(held.select("hash").distinct().withColumn("is_shared", F.lit(True)), "hash", "left").withColumn("is_shared", F.coalesce("is_shared", F.lit(False)))
    found = shaped.join(_carried(told, about, "key", min_docs), "key", "left_semi").select("id", "content", "line_no", "template")
    out = settle(found.unionByName(said).groupBy("id", "content", "line_no").agg(F.min("template").alias("template")), "recurring")
    drop(held, about, shaped, said)
    tidy(docs.sparkSession)
    return out


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with their recurring lines taken out of `text`, and with n_dropped_lines (int; an
    input column of that name is an error)."""
    if "n_dropped_lines" in docs.columns:
        raise ValueError("column n_dropped_lines exists already")
    gone = recurring_lines(docs, id_col, text, **options).groupBy(F.col("id").alias("__id"), F.col("content").alias("__text")).agg(F.collect_set("line_no").alias("__gone"))
    both = docs.withColumn("__content", F.xxhash64(text)).join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__content") == F.col("__text")), "left")
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return both.select(*(F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest).alias(text) if c == text else docs[c] for c in docs.columns), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias("n_dropped_lines"))
