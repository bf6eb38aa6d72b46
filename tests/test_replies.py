"""JSON in replies against plain loops over Python's json."""

from __future__ import annotations

import datetime
import decimal
import json
import random
import re

from pyspark.sql import functions as F

from lodestone.operators import replies

SCHEMA = "findings-v1"


def plain_object(reply):
    raw = (reply or "").strip()
    for part in [raw, *re.findall(r"```(?:json)?\s*([\s\S]*?)```", raw, re.I)]:
        part = part.strip()
        try:
            value = json.loads(part)
        except ValueError:
            try:
                value = json.JSONDecoder().raw_decode(part[part.index("{") :])[0]
            except ValueError:
                continue
        if isinstance(value, dict):
            return value
    return None


def test_embedded_objects(spark):
    given = [
        '{"a": 1}', 'x {"a": {"b": [1, "}"]}} y {"c": 2}', '```json\n{"a": 2}\n``` tail', 'no {brace ```JSON {"a": 3}```', '[{"a": 1}]', '"{\\"a\\": 1}"', "12", "", None, "{", "{}",
        '[{"a": 1}] ```\n{"b": 1}\n```', '[{"a": 1}] and more', "  \n {\"a\": \"é\\u00e9\"} ", "{'a': 1}", '{"a": 1,}', 'first ```{"a": ``` then ```json{"b": 2}```', "{a} {\"b\": 1}", '```json\n[1, {"z": 0}]\n```', '{"a": null, "b": true, "c": 1.5}', "x" * 20000 + '{"k": "' + "y" * 20000 + '"}' + "z}" * 500,
    ]
    rows = spark.createDataFrame(list(enumerate(given)), "k int, reply string").select("k", F.to_json(replies.embedded(F.col("reply"))).alias("o")).collect()
    got = {r.k: json.loads(r.o) if r.o is not None else None for r in rows}
    assert got == {k: plain_object(t) for k, t in enumerate(given)}


def cut(value, most):
    t = str(value or "").strip()
    return t if len(t) <= most else t[: most - 1] + "…"


def plain_findings(reply, recheck):
    o = plain_object(reply)
    if o is None:
        return "no JSON object", None, None, None
    if o.get("schema_version") != SCHEMA:
        return "other schema version", None, None, None
    verdict = str(o.get("verdict") or "").strip().lower()
    if verdict not in replies.VERDICTS:
        return "unknown verdict", None, None, None
    if not isinstance(o.get("findings"), list):
        return "findings are no list", None, None, None
    out = []
    for n, f in enumerate(o["findings"], 1):
        if n > 50 or not isinstance(f, dict) or not cut(f.get("claim"), 1200):
            continue
        ident = str(f.get("finding_id") or f"F-{n:03d}").strip().upper()
        severity, status = str(f.get("severity") or "major").lower(), str(f.get("status") or "open").lower()
        refs = f.get("evidence_refs") if isinstance(f.get("evidence_refs"), list) else []
        out.append((
            ident if re.fullmatch(r"F-[A-Z0-9_-]{1,24}", ident) else f"F-{n:03d}", severity if severity in replies.SEVERITIES else "major", cut(f["claim"], 1200),
            [cut(r, 500) for r in refs[:12] if cut(r, 500)], cut(f.get("verification"), 1000), status if status in (replies.RECHECKED if recheck else replies.OPEN) else "open",
        ))
    states = {f[-1] for f in out}
    if verdict == "pass" and states & {"open", "needs_owner"}:
        return "pass with open findings", None, None, None
    if verdict == "changes_required" and "open" not in states:
        return "changes without an open finding", None, None, None
    return None, verdict, cut(o.get("summary"), 2000), out


def test_findings(spark):
    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)

    def finding():
        f = {"finding_id": some("f-1", " F-ab_9 ", "G-1", "", None, 7, "F-" + "x" * 30), "severity": some("MAJOR", "note", "bad", None, 3), "claim": some("c", " d ", "", None, 0, "x" * 1300, 12), "status": some("open", "Resolved", "invalid", "needs_owner", None), "verification": some("v", None, "w" * 1001, [])}
        f["evidence_refs"] = some([], ["a", "", None, " b ", 5, 0, "r" * 600], "text", None, [str(i) for i in range(20)])
        return some(f, f, f, {k: v for k, v in f.items() if v is not None}, "text", [f])

    given = [None, "", "words", '{"schema_version": "other"}']
    for k in range(150):
        o = {"schema_version": some(SCHEMA, SCHEMA, SCHEMA, SCHEMA, 1), "verdict": some("pass", " Changes_Required ", "needs_owner", "needs_owner", "no", None), "summary": some("s", None, "é" * 2100), "findings": [finding() for _ in range(some(0, 1, 3, 60))] if k % 9 else some(None, {}, "x")}
        given.append(some("{}", "so: {} bye", "```json\n{}\n```").replace("{}", json.dumps(o)))
    for recheck in (False, True):
        rows = replies.review_findings(spark.createDataFrame(list(enumerate(given)), "k int, reply string"), "reply", SCHEMA, recheck).collect()
        got = {r.k: (r.problem, r.verdict, r.summary, None if r.findings is None else [(*f[:3], list(f[3]), *f[4:]) for f in r.findings]) for r in rows}
        assert got == {k: plain_findings(t, recheck) for k, t in enumerate(given)}
        assert sum(p[0] is None for p in got.values()) > 20


def test_fields_of_a_cut_body(spark):
    body = '{"x":[{"user":"pass","reason":"","path":"/a"},{"user" : "risk","reason":"r1"},{"user":"risk","rea'
    df = spark.createDataFrame([(1, body), (2, None), (3, '{"user":""'), (4, "")], "k int, body string")
    rows = replies.positional_fields(df, "body", "user", {"user": r'"user"\s*:\s*"([^"]+)"', "reason": r'"reason"\s*:\s*"([^"]*)"', "path": r'"path"\s*:\s*"([^"]+)"'}).orderBy("at").collect()
    assert [(r.k, r.at, r.user, r.reason, r.path) for r in rows] == [(1, 0, "pass", "", "/a"), (1, 1, "risk", "r1", None), (1, 2, "risk", None, None)]


def test_values_ready_for_json(spark):
    day, time = datetime.date(2024, 3, 7), datetime.datetime(2024, 3, 7, 1, 2, 3, 40)
    schema = "z struct<d:date,a:array<timestamp_ntz>>, m map<date,map<int,decimal(5,2)>>, t timestamp_ntz, n int"
    df = spark.createDataFrame([((day, [time, None, time.replace(microsecond=0)]), {day: {1: decimal.Decimal("2.50")}}, None, 5), (None, None, time, None)], schema)
    out = [r[0] for r in df.select(F.to_json(replies.json_ready(F.struct(*df.columns), df.schema), {"ignoreNullFields": "false"})).collect()]
    assert [json.loads(x) for x in out] == [
        {"m": {"2024-03-07": {"1": "2.50"}}, "n": 5, "t": None, "z": {"a": ["2024-03-07T01:02:03.000040", None, "2024-03-07T01:02:03"], "d": "2024-03-07"}},
        {"m": None, "n": None, "t": "2024-03-07T01:02:03.000040", "z": None},
    ]
