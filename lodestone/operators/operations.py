"""Proposed operations on comments: checked against their targets, then applied as one merge.

Operations on different comments do not touch each other; those on one comment apply in their order, each
seeing what the earlier ones wrote. So operations are sorted by the comment they touch (a created one
has an id from its source key, so that later operations and repeated creates find it) and folded as they are read.
The result is the next version of the table; nothing is written if an operation conflicts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("create", "update", "withdraw", "keep", "blocked", "candidate_resolved")
REVIEWER, MUTED = "ai-review", "muted_by_user"
#: Changes of a finding that a kept comment takes note of.
NOTED = ("resurfaced", "evidence_link_added")
COMMENT = {"source_key": "string", "content": "string", "finding_state": "string", "workflow": "string", "human_edited": "boolean", "source": "string", "comment_version": "long", "run_id": "string", "operation_id": "string", "signature": "string"}
OUTCOMES = {"create": "created", "update": "updated", "withdraw": "withdrawn", "keep": "kept", "candidate_resolved": "candidate_resolved"}
_DONE = {"operation_id": "string", "outcome": "string", "reason": "string", "from_version": "long", "to_version": "long"}
_FIELDS, _DID = (", ".join(f"{c}:{t}" for c, t in d.items()) for d in (COMMENT, _DONE))
_FOLDED = f"id string, before struct<{_FIELDS}>, after struct<{_FIELDS}>, done struct<{_DID}>"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([("id", pa.string()), *((n, pa.struct([(c, _TYPES[t]) for c, t in d.items()])) for n, d in (("before", COMMENT), ("after", COMMENT), ("done", _DONE)))])


def _said(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def checked(operations: DataFrame, comments: DataFrame) -> DataFrame:
    """`operations` (operation_id, place, action, finding_id, target_id, reason, proposed, verified,
    transition, resolution) with the action that may be taken and the reason if it is another one. Unknown
    actions are blocked. A create or update needs a proposed text, and keeps what is there if that is
    unverified; a resolution needs evidence and a target that no person controls; all but creates need a
    target. Ids lose odd characters; a blank or repeated one becomes `op-` and the place."""
    targets = comments.select(F.col("id").alias("__t"), F.coalesce("human_edited", F.lit(False)).alias("__human"), F.coalesce("source", F.lit("")).alias("__source")).where("__t is not null").dropDuplicates(["__t"])
    rows = operations.withColumn("target_id", _said("target_id")).join(targets, F.col("target_id") == F.col("__t"), "left")
    there, action, given = F.col("__t").isNotNull(), F.lower(_said("action")), _said("reason")
    rows = rows.withColumns({"__a": F.when(action.isin(*ACTIONS), action).otherwise("blocked"), "__r": given, "__has": F.col("proposed").isNotNull(), "__ok": F.coalesce("verified", F.lit(False))})

    def rule(test: Column, to: str, why: str) -> None:
        nonlocal rows
        reason = F.when(F.col("__r") == "", why).otherwise(F.col("__r"))
        rows = rows.withColumn("__hit", F.coalesce(test, F.lit(False))).withColumns({"__a": F.when(F.col("__hit"), to).otherwise(F.col("__a")), "__r": F.when(F.col("__hit"), reason).otherwise(F.col("__r"))}).drop("__hit")

    writes, resolves = F.col("__a").isin("create", "update"), F.col("__a") == "candidate_resolved"
    rule(writes & ~F.col("__has"), "blocked", "proposed comment failed validation")
    rule(writes & ~F.col("__ok"), "keep", "evidence_unverified")
    rule(resolves & ~there, "blocked", "target comment does not exist")
    rule(resolves & (F.col("__human") | (F.col("__source") != REVIEWER)), "blocked", "candidate_resolved cannot close human-controlled finding")
    rule(resolves & (_said("resolution") == ""), "blocked", "candidate_resolved requires explicit before/after/new evidence")
    unverified = (F.col("__a") == "keep") & (F.col("__r") == "evidence_unverified") & (F.col("target_id") == "")
    rule(F.col("__a").isin("update", "withdraw", "keep") & ~there & ~unverified, "blocked", "target comment does not exist")
    plain = F.regexp_replace(_said("operation_id"), r"[^A-Za-z0-9_.:-]", "")
    rows = rows.withColumn("__id", plain)
    first = rows.where("__id <> ''").groupBy(F.col("__id").alias("__k")).agg(F.min("place").alias("__p"))
    own = F.format_string("op-%03d", F.col("place"))
    taken = first.select(F.col("__k").alias("__g"), F.lit(True).alias("__taken"))
    rows = rows.join(first, (F.col("__id") == F.col("__k")) & (F.col("place") == F.col("__p")), "left").withColumn("__own", own).join(taken, F.col("__own") == F.col("__g"), "left")
    name = F.coalesce("__k", F.when(F.col("__taken"), F.concat("__own", F.lit("-"), F.col("place").cast("string"))).otherwise(F.col("__own")))
    return rows.select(name.alias("operation_id"), "place", F.col("__a").alias("action"), "finding_id", "target_id", F.col("__r").alias("reason"), "proposed", "transition")


def already_applied(operations: DataFrame, comments: DataFrame, run_id: str) -> DataFrame:
    """(operation_id, id): the comments that bear an operation of the run, by its id or by source key and
    signature: two equi-joins, as an OR condition would compare all with all."""
    o, c = operations.select("operation_id", "source_key", "signature"), comments.select("id", "source_key", "signature", F.col("run_id").alias("__run"), F.col("operation_id").alias("__op"))
    by_mark = o.join(c.where(F.col("__run") == run_id).select("id", F.col("__op").alias("operation_id")), "operation_id").select("operation_id", "id")
    by_text = o.join(c.select("id", "source_key", "signature"), ["source_key", "signature"]).select("operation_id", "id")
    return by_mark.unionByName(by_text).distinct()


def signature(action: Column, finding: Column, key: Column, target: Column, proposed: Column) -> Column:
    """Of a written text its own, else that of the operation."""
    canonical = F.to_json(F.struct(action.alias("action"), finding.alias("finding_id"), key.alias("source_key"), target.alias("target_comment_id")), {"ignoreNullFields": "false"})
    return F.left(F.sha2(F.when(proposed.isNotNull() & action.isin("create", "update"), proposed).otherwise(canonical), 256), F.lit(16))


def _json(c: Column) -> Column:
    """A string as it stands in `signature`'s JSON."""
    whole = F.to_json(F.struct(c.alias("k")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _step(c: dict, here: bool, op: dict, run_id: str) -> tuple[dict, bool, tuple]:
    """The comment after an operation, whether it is there, and what was done."""
    name, action = op["operation_id"], op["action"]
    key, said = (c["source_key"], c["__json"]) if here and c["source_key"] else (op["__key"], op["__json"])
    sign = op["__sign"] or hashlib.sha256(f"{op['__head']}{said}{op['__tail']}".encode()).hexdigest()[:16]
    marked = c["run_id"] == run_id and name is not None and c["operation_id"] == name
    same = here and (marked or (key is not None and c["source_key"] == key and c["signature"] == sign))
    text, noted = action in ("create", "update"), action == "keep" and here and op["proposed"] is not None and op["transition"] in NOTED
    conflict = None
    if action == "create" and here and not same:
        conflict = "the source key now has other content"
    elif action in ("update", "withdraw", "candidate_resolved") and not here:
        conflict = "the target no longer exists"
    elif action == "candidate_resolved" and (c["human_edited"] or c["source"] != REVIEWER):
        conflict = "a person controls the finding"
    elif action is not None and action not in OUTCOMES:
        conflict = "not acceptable"
    skipped = same and (text or (action == "withdraw" and c["finding_state"] == "withdrawn"))
    writes = conflict is None and not skipped and (text or action in ("withdraw", "candidate_resolved") or noted)
    version = (1 if c["comment_version"] is None else c["comment_version"]) if here else 0
    if writes:
        c = {**c, "comment_version": 1 if action == "create" else version + 1, "run_id": run_id, "operation_id": name, "signature": sign}
        if text or action == "withdraw":
            c |= {"source_key": key, "__json": said, "finding_state": "accepted" if text else "withdrawn"}
        if text:
            c |= {"content": op["proposed"], "source": REVIEWER if c["source"] is None else c["source"]}
        if action == "create":
            c["human_edited"] = False
        if action == "candidate_resolved":
            c["workflow"] = "candidate_resolved"
        elif noted and op["transition"] == "resurfaced" and c["workflow"] != MUTED:
            c["workflow"] = "resurfaced"
    outcome = "conflict" if conflict else "skipped" if skipped else OUTCOMES.get(action)
    return c, here or writes, (name, outcome, conflict, version, c["comment_version"] if writes else version)


def _played(run_id: str):
    """Rows sorted by comment, first the comment itself, then its operations: a row for each operation, and
    at the end one for the comment. What is held is a batch and one comment."""
    blank = dict.fromkeys([*COMMENT, "__json"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, name, base, c, here = False, None, None, blank, False
        kept = lambda x: x and {k: x[k] for k in COMMENT}
        end = lambda: {"id": name, "before": kept(base), "after": kept(c) if here else None, "done": None}
        for batch in batches:
            rows, out = [x.to_pylist() for x in batch.columns], []
            for values in zip(*rows, strict=True):
                op = dict(zip(batch.schema.names, values, strict=True))
                if not started or op["id"] != name:
                    if started:
                        out.append(end())
                    started, name, base, c, here = True, op["id"], None, blank, False
                if op["before"] is not None:
                    base, here = op["before"], True
                    c = {**base, "__json": op["__json"]}
                    continue
                c, here, done = _step(c, here, op, run_id)
                out.append({"id": name, "before": None, "after": None, "done": dict(zip(_DONE, done, strict=True))})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        if started:
            yield pa.RecordBatch.from_pylist([end()], schema=_ARROW)

    return run


def folded(comments: DataFrame, operations: DataFrame, run_id: str, session_id: str) -> DataFrame:
    """(id, before, after, done): a row with `before` and `after` for each comment that is there or that an
    operation touches, and one with `done` for each operation. Of comments with the same source key a
    create meets the one with the largest id. Ids are unique. Operations of one comment depend on each other: they
    are read in their order by one task, which holds the comment and not its operations."""
    spark = comments.sparkSession
    by_key = comments.where("source_key <> ''").groupBy("source_key").agg(F.max("id").alias("__by_key"))
    key = F.concat(F.lit(f"{session_id}:"), F.coalesce(F.nullif("finding_id", F.lit("")), F.col("operation_id")))
    ops = operations.withColumn("__key", key).join(by_key, (F.col("action") == "create") & (F.col("__key") == F.col("source_key")), "left")
    made = F.concat(F.lit("c-"), F.left(F.sha2("__key", 256), F.lit(16)))
    entity = F.when(F.col("action") == "create", F.coalesce("__by_key", made)).otherwise(F.coalesce("target_id", F.lit("")))
    # `signature` around the source key, which only the fold knows
    head, tail = F.to_json(F.struct("action", "finding_id"), {"ignoreNullFields": "false"}), F.to_json(F.struct(F.col("target_id").alias("target_comment_id")), {"ignoreNullFields": "false"})
    own = F.when(F.col("proposed").isNotNull() & F.col("action").isin("create", "update"), F.left(F.sha2("proposed", 256), F.lit(16)))
    order = ["place", "operation_id", "action", "finding_id", "target_id", "proposed", "transition"]
    ops = ops.select(entity.alias("id"), *order, "__key", _json(F.col("__key")).alias("__json"), F.concat(F.left(head, F.length(head) - 1), F.lit(',"source_key":')).alias("__head"), F.concat(F.lit(","), F.substr(tail, F.lit(2))).alias("__tail"), own.alias("__sign"))
    fields = F.struct(*(F.col(c).cast(t).alias(c) for c, t in COMMENT.items()))
    rows = comments.select("id", fields.alias("before"), _json(F.col("source_key").cast("string")).alias("__json"))
    touched = ops.select("id").distinct()
    both = rows.join(touched, "id", "left_semi").unionByName(ops, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a comment's own row has no place and no operation; of null places it is the first
    ordered = both.repartition(n, "id").withColumn("__op", F.col("before").isNull()).sortWithinPartitions("id", "__op", *order)
    fold = ordered.select("id", "before", *order[1:], "__key", "__json", "__head", "__tail", "__sign").mapInArrow(_played(run_id), _FOLDED)
    nothing = rows.join(touched, "id", "left_anti")
    return fold.unionByName(nothing.select("id", "before", F.col("before").alias("after"), F.lit(None).cast(fold.schema["done"].dataType).alias("done")))


def outcomes(merged: DataFrame) -> DataFrame:
    """(operation_id, id, outcome, reason, from_version, to_version), one row an operation."""
    return merged.where("done is not null").select("done.operation_id", "id", "done.outcome", "done.reason", "done.from_version", "done.to_version")


def applied(comments: DataFrame, operations: DataFrame, run_id: str, session_id: str) -> DataFrame:
    """The next version of `comments`; an error that names the first conflicts, if there are any."""
    merged = folded(comments, operations, run_id, session_id)
    if bad := outcomes(merged).where("outcome = 'conflict'").orderBy("operation_id").limit(5).collect():
        raise ValueError("; ".join(f"{x.operation_id}: {x.reason}" for x in bad))
    return merged.where("after is not null").select("id", "after.*")
