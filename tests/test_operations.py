"""Operations on comments against a plain loop over them."""

from __future__ import annotations

import hashlib
import json
import random

import pytest

from lodestone.operators import operations

FIELDS = list(operations.COMMENT)
COMMENT = "id string, " + ", ".join(f"{c} {t}" for c, t in operations.COMMENT.items())
OPERATION = "operation_id string, place long, action string, finding_id string, target_id string, proposed string, transition string"


def sign(op, key):
    action, finding, target, proposed = op[2], op[3], op[4], op[5]
    text = proposed if proposed is not None and action in ("create", "update") else json.dumps({k: v for k, v in (("action", action), ("finding_id", finding), ("source_key", key), ("target_comment_id", target))}, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def played(comments, ops, run, session):
    rows = {c[0]: dict(zip(FIELDS, c[1:])) for c in comments}
    by_source = {r["source_key"]: i for i, r in sorted(rows.items()) if r["source_key"]}
    out = {}
    for op in sorted(ops, key=lambda o: o[1]):
        name, _, action, finding, target, proposed, transition = op
        t = rows.get(target) if action != "create" else None
        key = (t and t["source_key"]) or f"{session}:{finding or name}"
        if action == "create":
            t = rows.get(by_source.get(key))
        s = sign(op, key)
        same = t is not None and ((t["run_id"] == run and t["operation_id"] == name) or (t["source_key"] == key and t["signature"] == s))
        stamp = {"run_id": run, "operation_id": name, "signature": s}
        version = (t["comment_version"] or 1) + 1 if t else 1
        if action == "create":
            if t:
                out[name] = "skipped" if same else "conflict"
                continue
            i = "c-" + hashlib.sha256(key.encode()).hexdigest()[:16]
            rows[i] = {"source_key": key, "content": proposed, "finding_state": "accepted", "workflow": None, "human_edited": False, "source": "ai-review", "comment_version": 1, **stamp}
            by_source[key] = i
            out[name] = "created"
        elif action == "keep":
            out[name] = "kept"
            if t and proposed is not None and transition in operations.NOTED:
                if transition == "resurfaced" and t["workflow"] != "muted_by_user":
                    t["workflow"] = "resurfaced"
                t.update(stamp, comment_version=version)
        elif action not in operations.OUTCOMES or t is None or (action == "candidate_resolved" and (t["human_edited"] or t["source"] != "ai-review")):
            out[name] = "conflict"
        elif action == "candidate_resolved":
            t.update(stamp, workflow="candidate_resolved", comment_version=version)
            out[name] = "candidate_resolved"
        elif same and (action == "update" or t["finding_state"] == "withdrawn"):
            out[name] = "skipped"
        elif action == "update":
            t.update(stamp, content=proposed, finding_state="accepted", source_key=key, source=t["source"] or "ai-review", comment_version=version)
            out[name] = "updated"
        else:
            t.update(stamp, finding_state="withdrawn", source_key=key, comment_version=version)
            out[name] = "withdrawn"
    return {(i, *(r[f] for f in FIELDS)) for i, r in rows.items()}, out


def some(seed):
    r = random.Random(seed)
    comments = [(f"k{k}", r.choice([f"s:F{k}", f"s:F{k}", None, ""]), r.choice(["old", "new"]), r.choice(["accepted", "withdrawn", None]), r.choice([None, "muted_by_user"]), r.choice([True, False, False, None]), r.choice(["ai-review", "ai-review", "person", None]), r.choice([1, 4, None]), r.choice(["run", "other", None]), r.choice([f"o{k}", "o3", None]), r.choice([hashlib.sha256(b"new").hexdigest()[:16], "x", None])) for k in range(30)]
    ops = [(f"o{k}", k, r.choice(["create", "update", "update", "withdraw", "keep", "candidate_resolved", "blocked"]), r.choice([f"F{r.randrange(40)}", "", None]), r.choice([f"k{r.randrange(32)}", f"k{r.randrange(5)}"]), r.choice(["new", "newer", "other"]), r.choice([None, "resurfaced", "evidence_link_added", "placement_refined"])) for k in range(80)]
    return comments, ops


@pytest.mark.parametrize("seed", [1, 2])
def test_operations_apply_in_their_order(spark, seed):
    comments, ops = some(seed)
    merged = operations.folded(spark.createDataFrame(comments, COMMENT).repartition(3), spark.createDataFrame(ops, OPERATION).repartition(3), "run", "s").cache()
    rows, results = played(comments, ops, "run", "s")
    got = operations.outcomes(merged).collect()
    assert {x.operation_id: x.outcome for x in got} == results and len(got) == len(ops)
    assert {tuple(x) for x in merged.where("after is not null").select("id", "after.*").collect()} == rows
    assert {"conflict", "skipped", "created", "updated", "withdrawn", "kept", "candidate_resolved"} == set(results.values())


def test_applying_again_changes_nothing(spark):
    comments = [("k1", "s:F1", "old", "accepted", None, False, "ai-review", 1, None, None, None), ("k2", None, "old", None, None, False, "ai-review", None, None, None, None)]
    ops = [("a", 1, "create", "F9", "", "new", None), ("b", 2, "update", "F1", "k1", "newer", None), ("c", 3, "withdraw", "F2", "k2", None, None), ("d", 4, "create", "F9", "", "new", None)]
    c, o = spark.createDataFrame(comments, COMMENT), spark.createDataFrame(ops, OPERATION)
    once = operations.applied(c, o, "run", "s")
    rows = {tuple(x) for x in once.collect()}
    assert {x[0] for x in rows} == {"k1", "k2", "c-" + hashlib.sha256(b"s:F9").hexdigest()[:16]}
    again = spark.createDataFrame([tuple(x) for x in once.collect()], COMMENT)
    assert {tuple(x) for x in operations.applied(again, o, "run", "s").collect()} == rows
    assert {x.outcome for x in operations.outcomes(operations.folded(again, o, "run", "s")).collect()} == {"skipped"}
    with pytest.raises(ValueError, match="other content"):
        operations.applied(again, spark.createDataFrame([("z", 1, "create", "F9", "", "else", None)], OPERATION), "run2", "s")
    assert operations.applied(c.limit(0), o.limit(0), "run", "s").count() == 0


def test_checked(spark):
    comments = spark.createDataFrame([("k1", True, "ai-review"), ("k2", False, "ai-review"), ("k3", None, "person")], "id string, human_edited boolean, source string")
    rows = [
        ("a!", 1, "Create", "F", "", "", "text", True, None, None), ("a", 2, "update", "F", "k1", "", None, True, None, None), ("", 3, "create", "F", "", "", "text", False, None, None),
        ("op-005", 4, "update", "F", "gone", "why", "text", True, None, None), ("a", 5, "withdraw", "F", " k1 ", None, None, None, None, None), ("r1", 6, "candidate_resolved", "F", "k1", "", None, None, None, "proof"),
        ("r2", 7, "candidate_resolved", "F", "k2", "", None, None, None, "proof"), ("r3", 8, "candidate_resolved", "F", "k2", "", None, None, None, " "), ("r4", 9, "candidate_resolved", "F", None, "", None, None, None, "proof"),
        ("r5", 10, "candidate_resolved", "F", "k3", "", None, None, None, "proof"), ("x", 11, "explode", "F", "k1", "", None, None, None, None), ("y", 12, "keep", "F", "", "", None, None, None, None), ("z", 13, "update", "F", "k2", "", "text", False, None, None),
    ]
    d = spark.createDataFrame(rows, "operation_id string, place long, action string, finding_id string, target_id string, reason string, proposed string, verified boolean, transition string, resolution string")
    got = {x.place: (x.operation_id, x.action, x.reason) for x in operations.checked(d, comments).collect()}
    assert got == {
        1: ("a", "create", ""), 2: ("op-002", "blocked", "proposed comment failed validation"), 3: ("op-003", "keep", "evidence_unverified"), 4: ("op-005", "blocked", "why"), 5: ("op-005-5", "withdraw", ""),
        6: ("r1", "blocked", "candidate_resolved cannot close human-controlled finding"), 7: ("r2", "candidate_resolved", ""), 8: ("r3", "blocked", "candidate_resolved requires explicit before/after/new evidence"), 9: ("r4", "blocked", "target comment does not exist"),
        10: ("r5", "blocked", "candidate_resolved cannot close human-controlled finding"), 11: ("x", "blocked", ""), 12: ("y", "blocked", "target comment does not exist"), 13: ("z", "keep", "evidence_unverified"),
    }


def test_already_applied(spark):
    c = spark.createDataFrame([("k1", "s", "x", "run", "o1"), ("k2", "t", "y", "old", "o2"), ("k3", None, None, "run", None)], "id string, source_key string, signature string, run_id string, operation_id string")
    o = spark.createDataFrame([("o1", "q", "q"), ("o2", "q", "q"), ("o3", "t", "y"), ("o4", None, None)], "operation_id string, source_key string, signature string")
    assert {tuple(x) for x in operations.already_applied(o, c, "run").collect()} == {("o1", "k1"), ("o3", "k2")}


def test_operations_of_one_comment_are_rows_of_their_own(spark):
    """Very many operations on one comment: no array of them is gathered, and keys are quoted as in JSON."""
    key = 's:F"\\\x01é/'
    comments = [("k1", None, "old", None, None, False, "ai-review", None, None, None, None)]
    ops = [(f"o{k}", k, ("update", "withdraw", "keep", "create")[k % 4], key[2:], "k1", "text" if k % 8 < 4 else None, "resurfaced" if k % 3 else None) for k in range(3000)]
    merged = operations.folded(spark.createDataFrame(comments, COMMENT), spark.createDataFrame(ops, OPERATION).repartition(3), "run", "s").cache()
    got = {x.operation_id: (x.id, x.outcome, x.from_version, x.to_version) for x in operations.outcomes(merged).collect()}
    assert len(got) == len(ops) and merged.count() == len(ops) + 2
    created, at = "c-" + hashlib.sha256(key.encode()).hexdigest()[:16], 1
    for name, k, action, *_ in ops:
        if action == "create":
            assert got[name] == (created, "created", 0, 1) if k == 3 else got[name][1] in ("conflict", "skipped")
        else:
            assert got[name][2] == at
            at = got[name][3]
    last = merged.where("id = 'k1' and after is not null").first().after
    assert last.comment_version == at and last.source_key == key
    by_hand = hashlib.sha256(r'{"action":"withdraw","finding_id":"F\"\\\u0001é/","source_key":"s:F\"\\\u0001é/","target_comment_id":"k1"}'.encode()).hexdigest()[:16]
    one = operations.folded(spark.createDataFrame(comments, COMMENT), spark.createDataFrame([ops[1]], OPERATION), "run", "s").where("after is not null").first().after
    assert one.signature == by_hand
