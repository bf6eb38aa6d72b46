"""Where quotes stand in texts, when the text or its typography has changed since.

All in column expressions; positions are 0-based code points of the text as it is. A quote is looked for
from left to right without overlaps. Nulls count as empty, and an empty quote stands nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters read as another one: spaces of other widths, curly quotation marks, dashes. Fixed values.
TYPOGRAPHY = {
    " ": "\u00a0\u2007\u202f\u2009\u2002\u2003\u2004\u2005\u2006\u2008\u200a\u3000",
    "'": "\u2018\u2019",
    '"': "\u201c\u201d",
    "-": "\u2013\u2014\u2212",
}
#: Code points of a context that count at most, on each side.
CONTEXT = 160
_ARRAY = "array<int>"


def _said(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def find_all(text: Column, quote: Column) -> Column:
    """array<int>: the starts of `quote` in `text`."""
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    between = F.transform(F.split(text, literal, -1), lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(_ARRAY).alias("at"))
    found = F.aggregate(between, zero, lambda s, n: F.struct((s["end"] + n + F.length(quote)).alias("end"), F.array_append(s["at"], s["end"] + n).alias("at")))["at"]
    return F.when((quote == "") | ~F.contains(text, quote), F.array().cast(_ARRAY)).otherwise(F.slice(found, F.lit(1), F.size(found) - 1))


def _before(text: Column, at: Column, context: Column) -> Column:
    """Whether `context` ends where `at` is."""
    n = F.least(F.length(context), at)
    return F.substr(text, at - n + 1, n) == context


def _after(text: Column, at: Column, context: Column) -> Column:
    return F.substr(text, at + 1, F.length(context)) == context


def _best(df: DataFrame, text: str, size: Column, prefix: Column, suffix: Column) -> DataFrame:
    """Adds __best: the start whose context fits better than that of all others, else -1."""
    scores = F.transform("__at", lambda i: F.when((prefix != "") & _before(F.col(text), i, prefix), 2).otherwise(0) + F.when((suffix != "") & _after(F.col(text), i + size, suffix), 2).otherwise(0))
    df = df.withColumn("__scores", scores).withColumn("__most", F.array_max("__scores"))
    alone = (F.col("__most") > 0) & (F.size(F.filter("__scores", lambda s: s == F.col("__most"))) == 1)
    best = F.when(alone, F.element_at("__at", F.array_position("__scores", F.col("__most")).cast("int"))).otherwise(-1)
    return df.withColumn("__best", best).drop("__scores", "__most")


def resolve(df: DataFrame, text: str, quote: str, prefix: str, suffix: str, recorded: str, recorded_rev: str, current_rev: str) -> DataFrame:
    """Adds state, index (-1 if none) and matches. missing: no match. unique: one. Of several matches,
    exact-revision: the recorded one, if it was recorded for the text's revision. context: the one match
    whose stored prefix and suffix fit best, and fit at all. Otherwise ambiguous."""
    t, q = _said(text), _said(quote)
    rows = df.withColumns({"__text": t, "__quote": q}).withColumn("__at", find_all(F.col("__text"), F.col("__quote")))
    head, tail = F.substr(_said(prefix), F.greatest(F.lit(1), F.length(_said(prefix)) - CONTEXT + 1)), F.left(_said(suffix), F.lit(CONTEXT))
    rows = _best(rows, "__text", F.length("__quote"), head, tail)
    n, at = F.size("__at"), F.col(recorded).cast("int")
    same = (_said(recorded_rev) != "") & (F.col(recorded_rev) == F.col(current_rev)) & F.array_contains("__at", at)
    state = F.when(n == 0, "missing").when(n == 1, "unique").when(same, "exact-revision").when(F.col("__best") >= 0, "context").otherwise("ambiguous")
    index = F.when(n == 1, F.get("__at", F.lit(0))).when((n > 1) & same, at).when(n > 1, F.col("__best")).otherwise(-1)
    return rows.select(*df.columns, state.alias("state"), index.alias("index"), F.col("__at").alias("matches"))


def plain_typography(text: Column) -> Column:
    """Spaces, quotation marks and dashes as on a keyboard, and line ends as one newline. Only a carriage
    return before a newline changes positions."""
    odd, plain = "".join(TYPOGRAPHY.values()), "".join(k * len(v) for k, v in TYPOGRAPHY.items())
    return F.translate(F.replace(F.translate(text, odd, plain), F.lit("\r\n"), F.lit("\n")), "\r", "\n")


def position_before_plain(text: Column, at: Column) -> Column:
    """array<int>: positions in `text` of those in its `plain_typography`: one more for each carriage
    return that was left out before them."""
    lengths = F.transform(F.split(text, "\r\n", -1), lambda x: F.length(x) + 1)
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(_ARRAY).alias("at"))
    ends = F.aggregate(lengths, zero, lambda s, n: F.struct((s["end"] + n).alias("end"), F.array_append(s["at"], s["end"] + n).alias("at")))["at"]
    # the last piece ends the text, past all positions
    return F.transform(at, lambda i: i + F.size(F.filter(ends, lambda e: e <= i)))


def verify(df: DataFrame, text: str, quote: str, before: str, after: str) -> DataFrame:
    """Adds verification_state, match_strategy, positions and normalized. A quote that stands in the text
    several times is unique if the whole of its contexts fits one place only. One that is not there is
    looked for again in plain typography, and positions are those of the text as it is."""
    rows = df.withColumns({"__text": _said(text), "__quote": _said(quote), "__b": _said(before), "__a": _said(after)}).withColumn("__at", find_all(F.col("__text"), F.col("__quote")))
    known = (F.col("__b") != "") | (F.col("__a") != "")
    fits = F.filter("__at", lambda i: known & _before(F.col("__text"), i, F.col("__b")) & _after(F.col("__text"), i + F.length("__quote"), F.col("__a")))
    rows = rows.withColumn("__fit", F.when(F.size("__at") > 1, fits))
    again = find_all(F.col("__plain"), plain_typography(F.col("__quote")))
    rows = rows.withColumn("__plain", F.when(F.size("__at") == 0, plain_typography(F.col("__text")))).withColumn("__found", F.coalesce(again, F.array().cast(_ARRAY)))
    rows = rows.withColumn("__loose", F.when(F.size("__found") > 0, position_before_plain(F.col("__text"), F.col("__found"))).otherwise(F.array().cast(_ARRAY)))
    n, loose = F.size("__at"), F.size("__loose")
    one = F.coalesce(F.size("__fit") == 1, F.lit(False))
    state = F.when((n == 1) | one | ((n == 0) & (loose == 1)), "verified_unique").when((n > 1) | (loose > 1), "verified_ambiguous").otherwise("unverified_missing")
    strategy = F.when(one, "quote_context").when((n > 0) | (loose == 0), "quote_exact").when(loose == 1, "quote_normalized_unique").otherwise("quote_normalized_ambiguous")
    positions = F.when(one, F.col("__fit")).when(n > 0, F.col("__at")).otherwise(F.col("__loose"))
    normalized = (n == 0) & (loose == 1)
    return rows.select(*df.columns, state.alias("verification_state"), strategy.alias("match_strategy"), positions.alias("positions"), normalized.alias("normalized"))


def collapsed(text: Column) -> Column:
    """(chars, at): the text without the marks * and `, runs of white space as one blank, and for each
    character left its position in the text."""
    space = lambda c: c.rlike(r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]$")
    each = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"), space(c).alias("space"))), lambda x: ~x["c"].isin("*", "`", ""))
    left = F.filter(each, lambda x, k: ~x["space"] | (k == 0) | ~F.coalesce(F.get(each, k - 1)["space"], F.lit(False)))
    return F.struct(F.array_join(F.transform(left, lambda x: F.when(x["space"], " ").otherwise(x["c"])), "").alias("chars"), F.transform(left, lambda x: x["i"]).alias("at"))


def choose_anchor(df: DataFrame, text: str, quote: str, prefix: str, suffix: str, recorded: str, occurrence: str) -> DataFrame:
    """Adds anchor_index and anchor (exact, normalized, ambiguous or missing): the occurrence with the
    given number if there are that many, the only one, the recorded one, or the one whose context fits
    best. Where the quote as it is stands nowhere, marks and runs of white space are looked over; then
    contexts do not count."""
    rows = df.withColumns({"__text": _said(text), "__quote": _said(quote)}).withColumn("__at", find_all(F.col("__text"), F.col("__quote")))
    rows = _best(rows, "__text", F.length("__quote"), _said(prefix), _said(suffix))
    lost = (F.size("__at") == 0) & (F.col("__quote") != "")
    rows = rows.withColumns({"__flat": F.when(lost, collapsed(F.col("__text"))), "__needle": F.when(lost, collapsed(F.col("__quote"))["chars"])})
    flat = F.transform(find_all(F.col("__flat.chars"), F.col("__needle")), lambda i: F.get(F.col("__flat.at"), i))
    rows = rows.withColumn("__loose", F.coalesce(F.when(lost, flat), F.array().cast(_ARRAY)))
    k, at = F.coalesce(F.col(occurrence), F.lit(-1)).cast("int"), F.coalesce(F.col(recorded), F.lit(-1)).cast("int")

    def pick(found: str) -> Column:
        n = F.size(found)
        return F.when((k >= 0) & (k < n), F.get(found, k)).when(n == 1, F.get(found, F.lit(0))).when(F.array_contains(found, at), at)

    exact, loose = pick("__at"), pick("__loose")
    some, others = F.size("__at") > 0, F.size("__loose") > 0
    index = F.when(some, F.coalesce(exact, F.col("__best"))).otherwise(F.coalesce(loose, F.lit(-1)))
    anchor = F.when(some, F.when(index >= 0, "exact").otherwise("ambiguous")).when(others, F.when(index >= 0, "normalized").otherwise("ambiguous")).otherwise("missing")
    return rows.select(*df.columns, index.alias("anchor_index"), anchor.alias("anchor"))
