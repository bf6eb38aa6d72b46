"""Candidates for expected events: each expected event takes the only candidate left that fits it.

Expected events decide in their order, and what one takes no later one can have. An event can decide as
soon as no earlier undecided event shares a candidate with it, so all such events decide in one round;
the rounds are as many as the longest chain of events that share candidates, not as many as events.

Only few events need these rounds, and pairs are made of kinds, not of rows. Candidates that are alike in
title, type and basis fit the same events, so that none of two or more of them is ever the only one left:
they are never taken, and who fits any of them takes nothing. Nor does an event whose candidates no event of
another kind can take before it, but for one. These events get their number of candidates by counting:
all that fit, less those that were taken before their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import cut

_PAIR = "gold_id string, place long, candidate_id string"


def _blank(c: str):
    return F.coalesce(F.col(c), F.lit("")) == ""


def pairs(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(gold_id, place, candidate_id) of all that fit. Candidates have candidate_id, title, event_type and
    basis; expected events gold_id, place (their order), title_regex, event_type and basis, of which
    blank ones ask for nothing. Candidates meet events by the type and basis asked for: each stands
    under four keys, with and without the two; the title is searched in what has met."""
    asks = expected.select("gold_id", "place", F.coalesce("title_regex", F.lit("")).alias("pattern"), F.when(~_blank("event_type"), F.col("event_type")).alias("t"), F.when(~_blank("basis"), F.col("basis")).alias("b"))
    asks = asks.withColumn("key", F.xxhash64(F.col("t").isNull(), "t", F.col("b").isNull(), "b"))
    ways = [F.struct((F.col("event_type") if t else F.lit(None).cast("string")).alias("t"), F.lit(not t).alias("no_t"), (F.col("basis") if b else F.lit(None).cast("string")).alias("b"), F.lit(not b).alias("no_b")) for t in (True, False) for b in (True, False)]
    keyed = candidates.select("candidate_id", "title", F.explode(F.array(*ways)).alias("w")).where("(w.no_t or w.t is not null) and (w.no_b or w.b is not null)")
    keyed = keyed.select("candidate_id", F.coalesce("title", F.lit("")).alias("title"), F.xxhash64("w.no_t", "w.t", "w.no_b", "w.b").alias("key"), F.col("w.t").alias("ct"), F.col("w.b").alias("cb"))
    met = asks.join(keyed, "key").where(F.col("t").eqNullSafe(F.col("ct")) & F.col("b").eqNullSafe(F.col("cb")))
    return met.where("pattern = '' or title rlike pattern").select("gold_id", "place", "candidate_id")


def _kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds __kind, a number that rows have in common if they are equal in `columns`."""
    kinds = cut(df.select(*columns).distinct().withColumn("__kind", F.monotonically_increasing_id()))
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return df.alias("a").join(kinds.alias("b"), same).select("a.*", "b.__kind")


def _contested(met: DataFrame, events: DataFrame) -> DataFrame:
    """The pairs (kind, candidate_id) of the kinds of events of which one may take a candidate. A kind takes
    one at most, as it has no candidate left then. Before its last event all of its candidates but one
    must have gone to other kinds, so those that no other kind fits whose first event comes before that are one
    at most. Kinds are left out until nothing changes."""
    span = cut(events.groupBy("__kind").agg(F.min("place").alias("first"), F.max("place").alias("last")))
    totals = met.groupBy("__kind").agg(F.max("n").alias("most"))
    left = cut(met.join(totals.where("most = 1").select("__kind"), "__kind").join(span, "__kind").select("__kind", "first", "last", F.col("one").alias("candidate_id")))
    many = left.count()
    while many:
        by = left.groupBy("candidate_id").agg(F.min("first").alias("a"), F.min_by("__kind", "first").alias("who"))
        # the first event of another kind
        rest = left.join(by, "candidate_id").where("__kind <> who").groupBy("candidate_id").agg(F.min("first").alias("b"))
        other = F.when(F.col("__kind") == F.col("who"), F.col("b")).otherwise(F.col("a"))
        safe = left.join(by, "candidate_id").join(rest, "candidate_id", "left").withColumn("other", other)
        stay = safe.groupBy("__kind").agg(F.count_if(F.col("other").isNull() | (F.col("other") > F.col("last"))).alias("own")).where("own <= 1")
        left = cut(left.join(stay.select("__kind"), "__kind"))
        many, before = left.count(), many
        if many == before:
            break
    return left.select("__kind", "candidate_id")


def _decided(open_: DataFrame) -> DataFrame:
    """(gold_id, place, match_count, candidate_id) of all events of the pairs."""
    decided = None
    while open_.take(1):
        # the place whose turn it is at each candidate; an event decides if it is its turn at all of its own
        turn = open_.groupBy("candidate_id").agg(F.min("place").alias("turn"))
        ready = open_.join(turn, "candidate_id").groupBy("gold_id", "place").agg(F.count("*").alias("match_count"), F.min("candidate_id").alias("one"), F.bool_and(F.col("turn") == F.col("place")).alias("ready"))
        now = cut(ready.where("ready").select("gold_id", "place", "match_count", F.when(F.col("match_count") == 1, F.col("one")).alias("candidate_id")))
        decided = now if decided is None else decided.unionByName(now)
        open_ = cut(open_.join(now.select("gold_id"), "gold_id", "left_anti").join(now.where("candidate_id is not null").select("candidate_id"), "candidate_id", "left_anti").select("gold_id", "place", "candidate_id"))
    return decided if decided is not None else open_.select("gold_id", "place", F.lit(None).cast("long").alias("match_count"), "candidate_id")


def matched(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each expected event: gold_id, matched, candidate_id, match_count (candidates left that
    fitted when it decided), expected_date, actual_date and date_status (not_scored, exact, unknown or
    mismatch). Candidate ids and places differ from each other; candidates without an id are left out."""
    candidates = candidates.where("candidate_id is not null")
    blank = lambda c: F.when(~_blank(c), F.col(c)).alias(c)
    asked = expected.select("gold_id", "place", F.coalesce("title_regex", F.lit("")).alias("title_regex"), blank("event_type"), blank("basis"))
    events = cut(_kinds(asked, ["title_regex", "event_type", "basis"]))
    kinds = events.groupBy(F.col("__kind").cast("string").alias("gold_id")).agg(F.lit(0).cast("long").alias("place"), *(F.first(c).alias(c) for c in ("title_regex", "event_type", "basis")))
    alike = cut(candidates.groupBy(F.coalesce("title", F.lit("")).alias("title"), "event_type", "basis").agg(F.count("*").alias("n"), F.min("candidate_id").alias("candidate_id")))
    met = pairs(alike, kinds).join(alike.select("candidate_id", "n"), "candidate_id")
    met = cut(met.select(F.col("gold_id").cast("long").alias("__kind"), F.col("candidate_id").alias("one"), "n"))
    contested = _contested(met, events)
    taken = cut(_decided(cut(events.join(contested, "__kind").select("gold_id", "place", "candidate_id"))))
    won = taken.where("candidate_id is not null").select("candidate_id", F.col("place").alias("at"))
    # of events and what was taken from their kind, by place: how much is gone at each event
    gone = met.join(won, F.col("one") == F.col("candidate_id")).select("__kind", F.col("at").alias("place"), F.lit(None).cast("string").alias("gold_id"), F.lit(1).alias("gone"))
    before = F.sum("gone").over(Window.partitionBy("__kind").orderBy("place", "gone").rowsBetween(Window.unboundedPreceding, 0))
    line = events.select("__kind", "place", "gold_id", F.lit(0).alias("gone")).unionByName(gone).withColumn("__gone", before).where("gone = 0")
    totals = met.groupBy("__kind").agg(F.sum("n").alias("n"))
    counts = line.join(totals, "__kind", "left").select("gold_id", (F.coalesce("n", F.lit(0)) - F.col("__gone")).alias("match_count"))
    dates = candidates.select("candidate_id", F.col("date").alias("actual_date"))
    rows = expected.select("gold_id", F.col("date").alias("expected_date")).join(counts, "gold_id", "left").join(taken.where("candidate_id is not null").select("gold_id", "candidate_id"), "gold_id", "left").join(dates, "candidate_id", "left")
    due = F.coalesce(F.col("expected_date").cast("string"), F.lit("")) != ""
    status = F.when(~due, "not_scored").when(F.col("actual_date") == F.col("expected_date"), "exact").when(F.col("actual_date").isNull(), "unknown").otherwise("mismatch")
    return rows.select("gold_id", F.col("candidate_id").isNotNull().alias("matched"), "candidate_id", F.coalesce("match_count", F.lit(0)).alias("match_count"), "expected_date", "actual_date", status.alias("date_status"))


def review_cases(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, matched, match_count) of expected cases for review; these consume nothing, and the
    candidate's boundary_status must be the case's. `cases` has case_id for gold_id."""
    met = pairs(candidates, cases.select(F.col("case_id").alias("gold_id"), F.lit(0).cast("long").alias("place"), "title_regex", "event_type", "basis"))
    met = met.join(candidates.select("candidate_id", "boundary_status"), "candidate_id").withColumnRenamed("gold_id", "case_id")
    met = met.join(cases.select("case_id", F.col("boundary_status").alias("asked")), "case_id").where(F.col("boundary_status").eqNullSafe(F.col("asked")))
    counts = met.groupBy("case_id").agg(F.count("*").alias("n"))
    return cases.select("case_id").join(counts, "case_id", "left").select("case_id", F.coalesce(F.col("n") == 1, F.lit(False)).alias("matched"), F.coalesce("n", F.lit(0)).alias("match_count"))


def unmatched(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates that no expected event took: for people to look at, not errors."""
    return candidates.join(results.where("matched").select("candidate_id"), "candidate_id", "left_anti")


def recall(results: DataFrame) -> DataFrame:
    """One row: expected and matched events, their share, and the share of exact dates among the events
    that have one; the share of nothing is 1."""
    due = F.col("date_status") != "not_scored"
    n, m, d, e = F.count("*"), F.count_if("matched"), F.count_if(due), F.count_if(F.col("date_status") == "exact")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return results.agg(n.alias("expected_events"), m.alias("matched_events"), share(m, n).alias("anchor_recall"), d.alias("expected_dates"), e.alias("exact_dates"), share(e, d).alias("exact_date_recall"))
