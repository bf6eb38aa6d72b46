"""Aggregations, rankings and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket_counts(df: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """(bucket, n): in how many buckets rows fall; a row may count in several, empty ones show 0."""
    one = df.agg(*(F.count_if(c).alias(k) for k, c in buckets.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("bucket"), F.col(k).alias("n")) for k in buckets))).alias("x")).select("x.*")


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key (the smallest of equals), its count, and unique_top: the
    value only if no other is as frequent."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), value)).alias("t"), F.max("n").alias("most"), F.collect_list("n").alias("all"))
    unique = F.size(F.filter("all", lambda x: x == F.col("most"))) == 1
    return top.select(key, F.col(f"t.{value}").alias(value), F.col("most").alias("n"), F.when(unique, F.col(f"t.{value}")).alias("unique_top"))


def ranked_search(df: DataFrame, terms: list[str], id_col: str, title: str, rest: Column, done: Column, limit: int = 12) -> DataFrame:
    """Rows that contain all terms, scored per term (exact id 100, id prefix 60, title 30, rest 5,
    each that holds) less 10 if done; the best `limit`."""
    ident, head, body = F.lower(F.col(id_col).cast("string")), F.lower(title), F.lower(rest)
    score, all_in = F.lit(0), F.lit(True)
    for t in terms:
        t = t.lower()
        hit = F.contains(ident, F.lit(t)) | F.contains(head, F.lit(t)) | F.contains(body, F.lit(t))
        all_in = all_in & hit
        score = score + F.when(ident == t, 100).when(ident.startswith(t), 60).otherwise(0) + F.when(F.contains(head, F.lit(t)), 30).otherwise(0) + F.when(F.contains(body, F.lit(t)), 5).otherwise(0)
    score = score - F.when(done, 10).otherwise(0)
    return df.where(all_in).withColumn("score", score).orderBy(F.desc("score"), id_col).limit(limit)


#: Points that a chain loses: for each blocked row, each decision that waits, each day by which a row is
#: stalled, each row above a stage's limit.
BLOCKED, WAITING, STALLED_DAY, STACKED = 40, 8, 6, 2


def _stages(df: DataFrame, chain: str, stage: str, done: Column, blocked: Column, waiting: Column, age_days: Column, wip: int, stalled_after: int) -> DataFrame:
    open_, late = ~done, ~done & (age_days > stalled_after)
    n = df.groupBy(chain, stage).agg(
        F.count_if(open_).alias("active"), F.count_if(done).alias("done"), F.count_if(open_ & blocked).alias("blocked"), F.count_if(open_ & waiting).alias("waiting"),
        F.count_if(late).alias("stalled"), F.coalesce(F.sum(F.when(late, age_days - stalled_after)), F.lit(0)).alias("stalled_days"),
    )
    return n.withColumn("stacked", F.greatest(F.lit(0), F.col("active") - wip))


def chain_health(df: DataFrame, chain: str, stage: str, done: Column, blocked: Column, waiting: Column, age_days: Column, wip: int = 6, stalled_after: int = 14, good: int = 90, warn: int = 70) -> DataFrame:
    """Per chain a score of 0 to 100, its tier, the signals it lost points for and its bottleneck: the stage
    with the heaviest single penalty, of equals the one with more active rows, then the smaller name.
    Two aggregations; no window holds a chain's rows."""
    n = _stages(df, chain, stage, done, blocked, waiting, age_days, wip, stalled_after)
    weight = F.greatest(F.col("blocked") * BLOCKED, F.col("waiting") * WAITING, F.col("stalled_days") * STALLED_DAY, F.col("stacked") * STACKED, F.when(F.col("active") > 0, 0.1).otherwise(0.0)).cast("double")
    reason = F.when(F.col("blocked") > 0, "blocked").when(F.col("waiting") > 0, "waiting").when(F.col("stalled") > 0, "stalled").when(F.col("stacked") > 0, "stacked").otherwise("active")
    total = lambda c: F.sum(c).alias(c)
    out = n.groupBy(chain).agg(*(total(c) for c in ("active", "done", "blocked", "waiting", "stalled", "stalled_days", "stacked")), F.min_by(F.struct(F.col(stage).alias("bottleneck"), reason.alias("reason")), F.struct(-weight, -F.col("active"), F.col(stage))).alias("b"))
    lost = F.col("blocked") * BLOCKED + F.col("waiting") * WAITING + F.col("stalled_days") * STALLED_DAY + F.col("stacked") * STACKED
    out = out.withColumn("score", F.greatest(F.lit(0), 100 - lost))
    return out.withColumn("tier", F.when(F.col("blocked") > 0, "bad").when(F.col("score") >= good, "good").when(F.col("score") >= warn, "warn").otherwise("bad")).select(chain, "score", "tier", "active", "done", "blocked", "waiting", "stalled", "stalled_days", "stacked", "b.bottleneck", "b.reason")


def health_status(sources: DataFrame, required: Column, status: Column, *by: str) -> DataFrame:
    """The state of a run from its sources' states, one row per `by` (or one in all). With required
    sources the first that holds: all failed; any failed; a warning; any ok. Without: all failed, else
    warnings decide. A failed source that is not required is a warning."""
    bad, warn = status.isin("failed", "missing"), status.isin("partial", "warning")
    r = sources.groupBy(*by).agg(
        F.count("*").alias("sources"), F.count_if(required).alias("required"), F.count_if(required & bad).alias("required_failed"), F.count_if(required & status.isin("ok", "ok_no_updates")).alias("required_ok"),
        F.count_if(bad).alias("failed"), F.count_if(warn | (~required & bad)).alias("warnings"),
    )
    with_req = F.when(F.col("required_failed") == F.col("required"), "failed").when(F.col("required_failed") > 0, "degraded").when(F.col("warnings") > 0, "complete_with_warning").when(F.col("required_ok") > 0, "complete").otherwise("degraded")
    without = F.when((F.col("sources") > 0) & (F.col("failed") == F.col("sources")), "failed").when(F.col("warnings") > 0, "complete_with_warning").otherwise("complete")
    return r.select(*by, F.when(F.col("required") > 0, with_req).otherwise(without).alias("health"), "sources", "required", "failed", "warnings")


def precision_recall(df: DataFrame, said: Column, true: Column) -> DataFrame:
    """One row of counts, precision and recall; an empty denominator gives 1."""
    c = df.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    rate = lambda a, b: F.when(b == 0, 1.0).otherwise(F.col(a) / b)
    p, r = rate("tp", F.col("tp") + F.col("fp")), rate("tp", F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), ((r == 1.0) & (p >= 0.9)).alias("passed"))


def exclusions(df: DataFrame, reasons: Column, known: list[str]) -> DataFrame:
    """(reason, n), with a zero for reasons that no row has."""
    found = df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(k,) for k in known], "reason string")
    return spine.join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def timeline(parts: list[DataFrame]) -> DataFrame:
    """Ledgers (columns ledger, ordinal, ts, kind, summary) as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sections(df: DataFrame, doc: str, at: str, length: Column) -> DataFrame:
    """Adds section_end: where the next section of the document starts, or the document's length."""
    w = Window.partitionBy(doc).orderBy(at)
    return df.withColumn("section_end", F.coalesce(F.lead(at).over(w), length))


def state_machine(df: DataFrame, key: str, event: str, order: list[str], moves: dict[str, str], start: str) -> DataFrame:
    """The state of each key after its events in order: as events that are not in `moves` (event ->
    state) keep the state, it is that of the last event which is. One aggregate with map-side combine."""
    table = F.create_map(*(F.lit(x) for kv in moves.items() for x in kv))
    d = df.select(key, F.struct(*order).alias("__at"), F.try_element_at(table, F.col(event)).alias("__state"))
    moved = F.when(F.col("__state").isNotNull(), F.col("__at"))
    return d.groupBy(key).agg(F.coalesce(F.max_by("__state", moved), F.lit(start)).alias("state"), F.count("__state").cast("int").alias("moves"))


def counts_by(df: DataFrame, key: Column, name: str, known: list[str] | None = None) -> DataFrame:
    """(name, n); with `known` only these, and with zeros for those that no row has."""
    if known is None:
        return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    one = df.agg(*(F.count_if(key == k).alias(k) for k in known))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias(name), F.col(k).alias("n")) for k in known))).alias("x")).select("x.*")


def share_by_member(df: DataFrame, member: Column, name: str, **flags: Column) -> DataFrame:
    """Per member the number of rows and how many each flag holds for."""
    return df.groupBy(member.alias(name)).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in flags.items()))
