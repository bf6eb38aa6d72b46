"""JSON out of noisy text: objects inside replies, checked findings, fields of cut-off bodies, values
made ready for JSON. All are column expressions; no text leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
VERDICTS = ["pass", "changes_required", "needs_owner"]
SEVERITIES = ["blocker", "major", "minor", "note"]
OPEN, RECHECKED = ["open", "needs_owner"], ["resolved", "open", "needs_owner", "invalid"]
MOST_FINDINGS, MOST_REFS = 50, 12
FENCED = r"(?is)```(?:json)?\s*(.*?)```"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def _other_value(x: Column) -> Column:
    """Whether a text is one whole JSON value that is no object: inside brackets it is a list of one."""
    one = F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1
    closed = F.json_object_keys(F.concat(F.lit('{"x":'), x, F.lit("}"))).isNotNull()
    return F.coalesce(~x.rlike(r"^\s*\{") & one & closed, F.lit(False))


def embedded(reply: Column) -> Column:
    """The first JSON object (variant) of a reply: the whole reply is tried, then each fenced part. In each
    the object may stand between other words: it begins at the first brace and what follows its end does
    not matter. A part that is a whole JSON value of another kind is passed over. Null if there is none.
    An object that repeats a key, or holds NaN, is no JSON here."""
    raw = _strip(F.coalesce(reply, F.lit("")))
    parts = F.concat(F.array(raw), F.regexp_extract_all(raw, F.lit(FENCED), F.lit(1)))
    starts = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("{")) & ~_other_value(_strip(p))), lambda p: F.substr(p, F.instr(p, F.lit("{"))))
    return F.get(F.filter(F.transform(starts, lambda s: F.try_parse_json(s)), lambda v: v.isNotNull()), F.lit(0))


def _filled(v: Column, path: str) -> Column:
    """A field's value as text; null if it is missing, null, empty, zero or false."""
    s, kind = F.try_variant_get(v, path, "string"), F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(F.when(kind == "STRING", s != "").otherwise(~s.isin("0", "0.0", "-0.0", "false", "[]", "{}")), s)


def cut_text(s: Column, most: int) -> Column:
    """Without white space around it, and with an ellipsis as its last character if it was too long."""
    t = _strip(F.coalesce(s, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))).otherwise(t)


def _one_of(s: Column, allowed: list[str], default: str) -> Column:
    low = F.lower(F.coalesce(s, F.lit(default)))
    return F.when(low.isin(allowed), low).otherwise(default)


def review_findings(df: DataFrame, reply: str, schema: str, recheck: bool = False) -> DataFrame:
    """Adds verdict, summary, findings and problem. A reply must hold an object of the schema version with a
    known verdict and a list of findings, of which the first 50 are read; those that are no objects or
    claim nothing go. A finding's id is F- and up to 24 letters, else its number; other fields have
    defaults and bounds; 12 references are read. `pass` must leave nothing open, `changes_required`
    something. `problem` says the first thing wrong, and then the other three are null; else it is null.
    Values that are no texts are read as their JSON. Columns of these names are replaced."""
    statuses = RECHECKED if recheck else OPEN

    def finding(x: Column, i: Column) -> Column:
        number = F.concat(F.lit("F-"), F.lpad((i + 1).cast("string"), 3, "0"))
        ident = F.upper(_strip(F.coalesce(_filled(x, "$.finding_id"), number)))
        refs = F.slice(F.coalesce(F.try_variant_get(x, "$.evidence_refs", "array<variant>"), F.array().cast("array<variant>")), 1, MOST_REFS)
        return F.struct(
            F.when(ident.rlike(r"\AF-[A-Z0-9_-]{1,24}\z"), ident).otherwise(number).alias("finding_id"),
            _one_of(_filled(x, "$.severity"), SEVERITIES, "major").alias("severity"),
            cut_text(_filled(x, "$.claim"), 1200).alias("claim"),
            F.filter(F.transform(refs, lambda r: cut_text(_filled(r, "$"), 500)), lambda r: r != "").alias("evidence_refs"),
            cut_text(_filled(x, "$.verification"), 1000).alias("verification"),
            _one_of(_filled(x, "$.status"), statuses, "open").alias("status"),
        )

    d = df.withColumn("__v", embedded(F.col(reply)))
    v = F.col("__v")
    d = d.withColumn("__raw", F.try_variant_get(v, "$.findings", "array<variant>")).withColumn("verdict", F.lower(_strip(F.coalesce(_filled(v, "$.verdict"), F.lit("")))))
    # Places are told before objects are sorted out, as a finding without an id has the number of its place.
    placed = F.transform(F.slice("__raw", 1, MOST_FINDINGS), lambda x, i: F.when(F.schema_of_variant(x).startswith("OBJECT"), finding(x, i)))
    d = d.withColumn("findings", F.filter(placed, lambda x: x.isNotNull() & (x["claim"] != "")))
    left = lambda states: F.exists("findings", lambda x: x["status"].isin(states))
    problem = (
        F.when(v.isNull(), "no JSON object").when(~F.coalesce(F.try_variant_get(v, "$.schema_version", "string") == schema, F.lit(False)), "other schema version")
        .when(~F.col("verdict").isin(VERDICTS), "unknown verdict").when(F.col("__raw").isNull(), "findings are no list")
        .when((F.col("verdict") == "pass") & left(OPEN), "pass with open findings").when((F.col("verdict") == "changes_required") & ~left(["open"]), "changes without an open finding")
    )
    d = d.withColumn("summary", cut_text(_filled(v, "$.summary"), 2000)).withColumn("problem", problem)
    kept = {c: F.when(F.col("problem").isNull(), F.col(c)) for c in ("verdict", "summary", "findings")}
    return d.withColumns(kept).drop("__v", "__raw")


def positional_fields(df: DataFrame, body: str, lead: str, patterns: dict[str, str]) -> DataFrame:
    """A row for each match of the pattern of `lead` in a body that may be cut off anywhere: the columns of
    df, `at` (0-based) and for each name the first group of its match with that number, null beyond."""
    found = df.withColumns({f"__{c}": F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(p), F.lit(1)) for c, p in patterns.items()})
    rows = found.select(*df.columns, *(f"__{c}" for c in patterns), F.posexplode(F.col(f"__{lead}")).alias("at", "__first"))
    return rows.select(*df.columns, "at", *(F.get(f"__{c}", F.col("at")).alias(c) for c in patterns))


def json_ready(x: Column, kind: T.DataType) -> Column:
    """A value as JSON can say it, at any depth: days and times as ISO texts (a fraction of six digits if
    there is one), decimals, bytes and intervals as texts, keys of maps as texts. Of keys that become
    equal the last one counts. Struct fields are in the order of their names."""
    if isinstance(kind, T.DateType):
        return F.date_format(x, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.date_format(x, "SSSSSS")
        return F.concat(whole, F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: json_ready(v, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(x.isNotNull(), F.struct(*(json_ready(x.getField(f.name), f.dataType).alias(f.name) for f in fields))) if fields else x
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(x), lambda e: F.struct(_key(e["key"], kind.keyType).alias("key"), json_ready(e["value"], kind.valueType).alias("value")))
        keys = F.transform(pairs, lambda e: e["key"])
        return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))
    return x if isinstance(kind, T.StringType | T.IntegralType | T.FloatType | T.DoubleType | T.BooleanType | T.NullType) else x.cast("string")


def _key(x: Column, kind: T.DataType) -> Column:
    made = json_ready(x, kind)
    return F.to_json(made) if isinstance(kind, T.ArrayType | T.StructType) else made.cast("string")
