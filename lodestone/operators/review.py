"""Review ledgers: attention, gates, spines of pages, repeats, sequences."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lodestone.functions.text import failing


def attention(issues: DataFrame, page: str, issue: str, order: str, impact: str, decision: str) -> DataFrame:
    """Per page: actionable, hard_blocker, needs_review, tip and ignored issues. Of the rows that repeat an
    issue of a page the first in order counts; a tip counts whatever was decided, an issue without a
    decision is pending. `attention_totals` sums them up."""
    first = issues.groupBy(page, issue).agg(F.min_by(F.struct(F.col(impact).alias("impact"), F.coalesce(decision, F.lit("pending")).alias("decision")), order).alias("i"))
    tip, ignored = F.col("i.impact") == "tip", F.col("i.decision") == "ignored"
    open_ = ~tip & ~ignored
    return first.groupBy(page).agg(
        F.count_if(open_).alias("actionable"), F.count_if(open_ & (F.col("i.impact") == "hard_blocker")).alias("hard_blocker"), F.count_if(open_ & (F.col("i.impact") != "hard_blocker")).alias("needs_review"),
        F.count_if(tip).alias("tip"), F.count_if(~tip & ignored).alias("ignored"),
    )


def attention_totals(pages: DataFrame) -> DataFrame:
    """One row: issues and pages of each kind, from what `attention` returns."""
    kinds = ("actionable", "hard_blocker", "needs_review", "tip")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c + "_issues")
    return pages.agg(*(total(k) for k in (*kinds, "ignored")), *(F.count_if(F.col(k) > 0).alias(k + "_pages") for k in kinds))


def page_recall(known: DataFrame, flagged: DataFrame, page: str) -> DataFrame:
    """One row: known defects, how many are on a flagged page, how many are not, and the share (null
    without known defects)."""
    hit = known.join(flagged.select(page).distinct().withColumn("__hit", F.lit(True)), page, "left")
    n = hit.agg(F.count("*").alias("known"), F.count("__hit").alias("detected"))
    return n.select("known", "detected", (F.col("known") - F.col("detected")).alias("missed"), F.when(F.col("known") > 0, F.round(F.col("detected") / F.col("known"), 4)).alias("page_recall"))


def page_spine(report: DataFrame, document: str, page: str, *sides: DataFrame) -> DataFrame:
    """Every page of each document from 1 to its last reported one, with what the report and the sides
    (a row per document and page) know of it."""
    ends = report.groupBy(document).agg(F.max(page).alias("__last")).where("__last >= 1")
    out = ends.select(document, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__last").cast("long"))).alias(page))
    for side in (report, *sides):
        out = out.join(side, [document, page], "left")
    return out


def red_page_gate(before: DataFrame, after: DataFrame, page: str, red: str, target: Column) -> DataFrame:
    """One row: red pages before and after, new ones, whether a target page is still red, and the gate:
    'pass' if neither. A page is red if any of its rows is."""
    was = before.where(F.col(red)).select(page).distinct().withColumn("__was", F.lit(True))
    now = after.where(F.col(red)).select(page).distinct().withColumn("__now", F.lit(True))
    n = was.join(now, page, "full").agg(F.count("__was").alias("red_before"), F.count("__now").alias("red_after"), F.count_if(F.col("__now") & F.col("__was").isNull()).alias("new_red"), F.coalesce(F.bool_or(F.col("__now") & target), F.lit(False)).alias("target_red"))
    return n.withColumn("gate", F.when(F.col("target_red") | (F.col("new_red") > 0), "fail").otherwise("pass"))


def id_delta(previous: DataFrame, following: DataFrame, key: str) -> DataFrame:
    """One row: ids that came, that went, and how many there were before and after."""
    was = previous.select(key).distinct().withColumn("__was", F.lit(True))
    now = following.select(key).distinct().withColumn("__now", F.lit(True))
    return was.join(now, key, "full").agg(F.count_if(F.col("__was").isNull()).alias("added"), F.count_if(F.col("__now").isNull()).alias("removed"), F.count("__was").alias("before"), F.count("__now").alias("after"))


def latest_for(left: DataFrame, right: DataFrame, key: str, valid: Column, order: Column, fields: list[str]) -> DataFrame:
    """`left` with the fields of the last valid row of each key (nulls if there is none). One aggregate
    per key before the join, so that no key's rows are gathered."""
    last = right.where(valid).groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("__last"))
    return left.join(last, key, "left").select(*left.columns, *(F.col(f"__last.{f}").alias(f) for f in fields))


def merged_repeats(df: DataFrame, key: str, order: str, kept: list[str], filled: str, source: str, glue: str = ", ") -> DataFrame:
    """One row a key: `kept` of its first row, the first `filled` that is not empty ('' if none), and its
    sources in order of appearance, each joined on unless the text so far contains it. The list that is
    gathered holds different sources only."""
    each = df.groupBy(key, source).agg(F.min(order).alias("__at"), F.min_by(F.struct(*kept), order).alias("__kept"), F.min_by(F.struct(F.col(order).alias("at"), F.col(filled).alias("text")), F.when(F.coalesce(F.col(filled), F.lit("")) != "", F.col(order))).alias("__filled"))
    one = each.groupBy(key).agg(F.min_by("__kept", "__at").alias("__kept"), F.min("__filled").alias("__filled"), F.sort_array(F.collect_list(F.struct("__at", F.coalesce(source, F.lit("")).alias("s")))).alias("__s"))
    names = F.transform("__s", lambda x: x.s)
    joined = F.aggregate(F.slice(names, 2, F.size(names)), F.get(names, F.lit(0)), lambda a, x: F.when(F.contains(a, x), a).otherwise(F.concat(a, F.lit(glue), x)))
    return one.select(key, *(F.col(f"__kept.{c}").alias(c) for c in kept), F.coalesce("__filled.text", F.lit("")).alias(filled), joined.alias(source))


def status_counts(df: DataFrame, key: str, status: str, required: Column, known: tuple[str, ...] = ("pending", "done", "skipped", "failed")) -> DataFrame:
    """Per key: total and the count of each known status of the rows that need one; an empty status is
    the first known one, an unknown status the last."""
    told = F.when(F.coalesce(F.trim(status), F.lit("")) == "", known[0]).when(F.col(status).isin(*known), F.col(status)).otherwise(known[-1])
    return df.where(required).withColumn("__status", told).groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col("__status") == k).alias(k) for k in known))


def next_numbers(names: DataFrame, counters: DataFrame, prefix: str, name: str, counter: str) -> DataFrame:
    """Per prefix of `counters`: one more than the larger of its counter (at least 0) and the largest number
    in a name `<prefix>-<digits>_...` or `<prefix>-<digits>.md`."""
    number = F.regexp_extract(F.substr(name, F.length(prefix) + 1), r"^-([0-9]+)(?:_|\.md$)", 1)
    used = names.where(F.startswith(F.col(name), F.col(prefix))).groupBy(prefix).agg(F.max(F.nullif(number, F.lit("")).try_cast("long")).alias("__used"))
    return counters.join(used, prefix, "left").select(prefix, (F.greatest(F.coalesce(counter, F.lit(0)), F.coalesce("__used", F.lit(0)), F.lit(0)).cast("long") + 1).alias("next"))


def region_signature(page: Column, kind: Column, region: Column, kinds: list[str], step: int = 8) -> Column:
    """Canonical JSON of a page, an issue's type and its region, whose first four values are rounded to
    multiples of `step` (halves to even ones; fewer than four: no region); null for other types."""
    cells = F.transform(F.slice(region, 1, 4), lambda v: (F.bround(v / step) * step).cast("long").cast("string"))
    inside = F.when(F.size(region) >= 4, F.array_join(cells, ",")).otherwise("")
    return F.when(kind.isin(*kinds), F.concat(F.lit('{"page":'), page.cast("string"), F.lit(',"region":['), inside, F.lit('],"type":"'), kind, F.lit('"}')))


def latest_feedback(projects: DataFrame, feedback: DataFrame, key: str, order: str, outcome: str, next_check: str, note: str) -> DataFrame:
    """`projects` (key, due_at, action) with the last feedback of each key applied: one without progress
    moves due_at to its next check if it names one, a handled one sets the action to 'no_action' with the
    trimmed note as its reason. Projects without feedback stay; `outcome` is null for them."""
    last = feedback.groupBy(key).agg(F.max_by(F.struct(F.col(outcome).alias("outcome"), F.col(next_check).alias("next"), F.col(note).alias("note")), order).alias("__f"))
    f = lambda c: F.col(f"__f.{c}")
    moved, handled = (f("outcome") == "no_progress") & (F.coalesce(f("next"), F.lit("")) != ""), f("outcome") == "handled"
    return projects.join(last, key, "left").select(key, F.when(moved, f("next")).otherwise(F.col("due_at")).alias("due_at"), F.when(handled, "no_action").otherwise(F.col("action")).alias("action"), F.when(handled, F.trim(F.coalesce(f("note"), F.lit("")))).alias("reason"), f("outcome").alias("outcome"))


def reconciled(cards: DataFrame, decisions: DataFrame, signals: DataFrame, key: str, order: str) -> DataFrame:
    """Cards (key, revision, question, status, state) after decisions (key, revision, question, order) and
    signals (key). A decision replaces its card if its revision is not below the card's; of several the
    highest revision wins, of equal ones the last. Keys without a card get one. A signal closes a card
    that is there after the decisions, and nothing else."""
    best = decisions.withColumn("__r", F.coalesce("revision", F.lit(0))).groupBy(key).agg(F.max_by(F.struct(F.col("__r").alias("revision"), "question"), F.struct("__r", order)).alias("__d"))
    both = cards.withColumn("__card", F.lit(True)).join(best, key, "full")
    taken = F.col("__d").isNotNull() & (F.col("__d.revision") >= F.coalesce("revision", F.lit(0)))
    closed = signals.select(key).distinct().withColumn("__closed", F.lit(True))
    now = both.select(key, *(F.when(taken, new).otherwise(old).alias(c) for c, new, old in (
        ("revision", F.col("__d.revision"), F.col("revision")), ("question", F.coalesce("__d.question", F.col(key).cast("string")), F.col("question")),
        ("status", F.lit("review"), F.when(F.col("__card"), F.col("status")).otherwise("review")), ("state", F.lit("pending"), F.col("state")),
    )))
    done = F.col("__closed").isNotNull()
    return now.join(closed, key, "left").select(key, "revision", "question", F.when(done, "done").otherwise(F.col("status")).alias("status"), F.when(done, "auto_closed").otherwise(F.col("state")).alias("state"))


def acceptance(operations: DataFrame, requested: DataFrame, run: str, op: str, action: str) -> DataFrame:
    """Per run: operations asked for, and a code. 'operation_ids_conflict' if none is asked for, one is
    asked for twice or unknown, or the run's own ids are ambiguous; 'blocked_operation' if one of them is
    blocked; else 'ok'. Runs that only `requested` knows are unknown, so theirs conflict."""
    own = operations.groupBy(run, op).agg(F.count("*").alias("__n"), F.bool_or(F.col(action) == "blocked").alias("__blocked"))
    asked = requested.groupBy(run, op).agg(F.count("*").alias("__k"))
    n = own.join(asked, [run, op], "full").groupBy(run).agg(F.coalesce(F.sum("__k"), F.lit(0).cast("long")).alias("asked"), F.bool_or((F.col("__k") > 1) | (F.col("__n") > 1) | F.col("__n").isNull()).alias("bad"), F.bool_or(F.col("__k").isNotNull() & F.col("__blocked")).alias("held"))
    conflict = (F.col("asked") == 0) | F.coalesce("bad", F.lit(False))
    return n.select(run, "asked", F.when(conflict, "operation_ids_conflict").when(F.col("held"), "blocked_operation").otherwise("ok").alias("code"))


def reused_attempts(attempts: DataFrame, order: str, key: list[str]) -> DataFrame:
    """`attempts` with attempt_id, from a hash of their key, and first_order: the first attempt with this
    key if it is an earlier one, else null. A minimum per key meets the rows again; none are gathered."""
    text = F.to_json(F.struct(*sorted(key)), {"ignoreNullFields": "false"})
    named = attempts.withColumn("attempt_id", F.concat(F.lit("attempt-"), F.left(F.sha2(text, 256), F.lit(16))))
    first = named.groupBy("attempt_id").agg(F.min(order).alias("__first"))
    return named.join(first, "attempt_id").withColumn("first_order", F.when(F.col("__first") < F.col(order), F.col("__first"))).drop("__first")


def changed_ids(previous: DataFrame, following: DataFrame, key: str, volatile: list[str]) -> DataFrame:
    """Keys that are in both and differ in a column that is not volatile (null equals null)."""
    kept = sorted(set(previous.columns) & set(following.columns) - {key, *volatile})
    return previous.select(key, F.struct(*kept).alias("__was")).join(following.select(key, F.struct(*kept).alias("__now")), key).where(~F.col("__was").eqNullSafe(F.col("__now"))).select(key).distinct()


def carried(start: Column, stays: Column, window: WindowSpec) -> Column:
    """Rows at which a state begins, or that come after one that is in it and may stay in it."""
    start, stays = F.coalesce(start, F.lit(False)), F.coalesce(stays, F.lit(False))
    return F.coalesce(F.last(F.when(start | ~stays, start), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))


def page_types(pages: DataFrame, document: str, page: str, marks: dict[str, tuple[Column, Column]], cells: Column, dense: Column, short: Column) -> DataFrame:
    """`pages` with type. Each mark (begins, goes on) carries over to following pages, earlier marks before
    later ones; then tables of cells, dense tables and short pages right after these, else narrative. The
    window is a document's pages."""
    w = Window.partitionBy(document).orderBy(page)
    free, kind = F.lit(True), F.lit(None).cast("string")
    for name, (begins, goes_on) in marks.items():
        pages = pages.withColumn(f"__{name}", free & begins).withColumn(f"__{name}", carried(F.col(f"__{name}"), free & goes_on, w))
        kind, free = F.coalesce(kind, F.when(F.col(f"__{name}"), name)), free & ~F.col(f"__{name}")
    whole = free & ~cells & dense
    pages = pages.withColumn("__dense", whole).withColumn("__goes_on", carried(F.col("__dense"), free & ~cells & short, w))
    kind = F.coalesce(kind, F.when(cells, "cell_table").when(F.col("__dense"), "dense_table").when(F.col("__goes_on"), "dense_table_continuation").otherwise("narrative"))
    return pages.withColumn("type", kind).drop(*(f"__{name}" for name in marks), "__dense", "__goes_on")


def placed(nodes: DataFrame, column: Column, order: str, within: list[str], width: int = 340, height: int = 170) -> DataFrame:
    """`nodes` with x and y: the place of their column in the graph that `within` names, and how many
    nodes of it come before."""
    row = F.row_number().over(Window.partitionBy(*within, "__c").orderBy(order)) - 1
    return nodes.withColumn("__c", column).withColumn("y", (row * height).cast("long")).withColumn("x", (F.col("__c") * width).cast("long")).drop("__c")


def width_of_title(text: Column) -> Column:
    """UTF-16 units, those outside ASCII twice, halved and rounded up."""
    ascii_ = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    astral = F.length(text) - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]+", ""))
    return F.floor((2 * F.length(text) - ascii_ + 2 * astral + 1) / 2)


def clamped(value: Column) -> Column:
    """A number between 0 and 1; what is none is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """(share of the smaller area that two boxes (x0, y0, x1, y1) share, share of the smaller width); areas
    and widths below 1 count as 1."""
    across, down = (F.greatest(F.lit(0.0), F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k])) for k in (0, 1))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return across * down / F.greatest(F.lit(1.0), F.least(area(a), area(b))), across / F.greatest(F.lit(1.0), F.least(a[2] - a[0], b[2] - b[0]))


def preflight(items: DataFrame, page: str, key: str, family: str, blocked: str, order: str) -> DataFrame:
    """(page, family, keys, source_count, status, blocked_reasons): what a repair of each page would do. A
    page whose items are of more than one family, or of which an item has reasons of its own, is blocked;
    its reasons come in the order of its items, each once. A missing family is a family too."""
    said = F.coalesce(family, F.lit(""))
    rows = items.groupBy(page).agg(F.sort_array(F.collect_set(said)).alias("__f"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.coalesce(blocked, F.array().cast("array<string>")).alias("b")))).alias("__items"))
    several = F.size("__f") > 1
    own = F.flatten(F.transform("__items", lambda x: x["b"]))
    mixed = F.when(several, F.array(F.concat(F.lit("families that do not go together: "), F.array_join("__f", ", ")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__reasons", F.array_distinct(F.concat(own, mixed)))
    return rows.select(page, F.when(~several, F.get("__f", F.lit(0))).alias("family"), F.transform("__items", lambda x: x["k"]).alias("keys"), F.size("__items").alias("source_count"), F.when(F.size("__reasons") > 0, "blocked").otherwise("ready").alias("status"), F.col("__reasons").alias("blocked_reasons"))


def preflight_totals(plans: DataFrame, budget: int = 12) -> DataFrame:
    """One row: pages ready and blocked, and whether the ready ones, a request each, are in the budget."""
    ready = F.count_if(F.col("status") == "ready")
    return plans.agg(ready.alias("ready_pages"), F.count_if(F.col("status") == "blocked").alias("blocked_pages"), (ready <= budget).alias("budget_ok"))


def comment_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) between two snapshots with content_hash, human_edited, lifecycle_state,
    finding_state and replies; a comment may have several changes: added, edited, withdrawn, restored and
    replied. One that is gone is withdrawn. Withdrawal and its end are no edits by themselves."""
    fields = ("content_hash", "human_edited", "lifecycle_state", "finding_state", "replies")
    b, a = (d.select(key, F.struct(*fields).alias(n)) for d, n in ((before, "b"), (after, "a")))
    rows = b.join(a, key, "full_outer")
    here, gone = F.col("a").isNotNull(), F.col("b").isNotNull()
    both = here & gone
    out = lambda s: F.coalesce(F.col(f"{s}.lifecycle_state") == "withdrawn", F.lit(False)) | F.coalesce(F.col(f"{s}.finding_state") == "withdrawn", F.lit(False))
    differs = lambda *names: reduce(or_, (~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names))
    edited = differs("content_hash", "human_edited") | (differs("lifecycle_state", "finding_state") & (out("a") == out("b")))
    rules = {"added": ~gone, "edited": both & edited, "withdrawn": ~here | (both & ~out("b") & out("a")), "restored": both & out("b") & ~out("a"), "replied": both & differs("replies")}
    return rows.select(key, F.explode(failing(**rules)).alias("change"))
