"""Queries of JSON inside replies. Turns of conversations stand for replies, events for bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import replies
from lodestone.plans.catalogue import query, table

#: A turn's reply in one of six dresses; what it says comes from the turn.
_OBJECT_SQL = """json_object('schema_version', CASE WHEN turn % 11 = 10 THEN 'v0' ELSE 'v1' END, 'verdict', ['Pass', 'changes_required', 'needs_owner', 'maybe'][1 + (conv_id + turn) % 4], 'summary', text,
 'findings', [json_object('claim', text, 'severity', 'MINOR', 'status', ['resolved', 'open'][1 + conv_id % 2], 'evidence_refs', [role, '', text]), json_object('claim', '', 'finding_id', 'f-9'), json_object('claim', 'again', 'finding_id', ' f-x ', 'status', 'invalid')])"""
_REPLY_SQL = f"""SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN o WHEN 1 THEN 'So: ' || chr(96) || chr(96) || chr(96) || 'json' || chr(10) || o || chr(10) || chr(96) || chr(96) || chr(96) || ' {{done' WHEN 2 THEN 'Result ' || o || ' and {{more}}' WHEN 3 THEN '[' || o || ']'
 WHEN 4 THEN 'broken {{x ' || chr(96) || chr(96) || chr(96) || o || chr(96) || chr(96) || chr(96) ELSE left(o, 60) END AS reply FROM (SELECT conv_id, turn, {_OBJECT_SQL}::VARCHAR AS o FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))"""
#: The object of a part ends at the first closing brace with which it is valid JSON.
_FOUND_SQL = rf"""WITH r AS ({_REPLY_SQL}), p AS (SELECT conv_id, turn, unnest(list_concat([reply], regexp_extract_all(reply, '(?i)```(?:json)?\s*((?s:.*?))```', 1))) AS part, generate_subscripts(list_concat([reply], regexp_extract_all(reply, '(?i)```(?:json)?\s*((?s:.*?))```', 1)), 1) AS k FROM r),
 s AS (SELECT conv_id, turn, k, CASE WHEN json_valid(part) AND json_type(part) <> 'OBJECT' THEN NULL ELSE substr(part, nullif(position('{{' IN part), 0)) END AS s FROM p),
 f AS (SELECT conv_id, turn, k, list_filter(list_transform(range(1, len(x)), lambda i: array_to_string(x[1:i], '}}') || '}}'), lambda c: json_valid(c))[1] AS o FROM (SELECT *, string_split(s, '}}') AS x FROM s)),
 o AS (SELECT conv_id, turn, arg_min(o, k) AS o FROM f WHERE o IS NOT NULL GROUP BY ALL)"""


def _replies(spark, sf_dir):
    c, text, k = table(spark, sf_dir, "conversations"), F.coalesce("text", F.lit("")), F.col("conv_id") + F.col("turn")
    finding = lambda claim, ident=None, severity=None, status=None, refs=None: F.struct(claim.alias("claim"), *(F.coalesce(x, F.lit(None).cast(t)).alias(n) for x, t, n in ((ident if ident is not None else F.lit(None), "string", "finding_id"), (severity if severity is not None else F.lit(None), "string", "severity"), (status if status is not None else F.lit(None), "string", "status"), (refs if refs is not None else F.lit(None), "array<string>", "evidence_refs"))))
    findings = F.array(
        finding(text, severity=F.lit("MINOR"), status=F.get(F.array(F.lit("resolved"), F.lit("open")), F.col("conv_id") % 2), refs=F.array(F.col("role"), F.lit(""), text)),
        finding(F.lit(""), F.lit("f-9")), finding(F.lit("again"), F.lit(" f-x "), status=F.lit("invalid")),
    )
    verdict = F.get(F.array(*map(F.lit, ("Pass", "changes_required", "needs_owner", "maybe"))), k % 4)
    o = F.to_json(F.struct(F.when(F.col("turn") % 11 == 10, "v0").otherwise("v1").alias("schema_version"), verdict.alias("verdict"), text.alias("summary"), findings.alias("findings")))
    fence, case = F.lit("```"), k % 6
    dressed = (
        F.when(case == 0, o).when(case == 1, F.concat(F.lit("So: ```json\n"), o, F.lit("\n``` {done"))).when(case == 2, F.concat(F.lit("Result "), o, F.lit(" and {more}"))).when(case == 3, F.concat(F.lit("["), o, F.lit("]")))
        .when(case == 4, F.concat(F.lit("broken {x "), fence, o, fence)).otherwise(F.left(o, F.lit(60)))
    )
    return c.select("conv_id", "turn", dressed.alias("reply"))


@query(_FOUND_SQL + "SELECT conv_id, turn, o ->> '$.summary' AS summary, o ->> '$.findings[0].evidence_refs[0]' AS role FROM r LEFT JOIN o USING (conv_id, turn)")
def embedded_json(spark, sf_dir):
    v = _replies(spark, sf_dir).withColumn("v", replies.embedded(F.col("reply")))
    return v.select("conv_id", "turn", F.try_variant_get("v", "$.summary", "string").alias("summary"), F.try_variant_get("v", "$.findings[0].evidence_refs[0]", "string").alias("role"))


@query(_FOUND_SQL + r""", t AS (SELECT r.conv_id, r.turn, o, lower(o ->> '$.verdict') AS said, list_filter(list_transform(from_json(o -> '$.findings', '["JSON"]'), lambda x, i: {'id': CASE WHEN regexp_full_match(upper(trim(coalesce(x ->> '$.finding_id', ''))), 'F-[A-Z0-9_-]{1,24}') THEN upper(trim(x ->> '$.finding_id')) ELSE 'F-' || lpad(i::VARCHAR, 3, '0') END,
  'severity': coalesce(lower(x ->> '$.severity'), 'major'), 'claim': regexp_replace(x ->> '$.claim', '^\s+|\s+$', '', 'g'), 'refs': len(list_filter(from_json(coalesce(x -> '$.evidence_refs', '[]'), '["VARCHAR"]'), lambda y: regexp_matches(y, '\S'))), 'status': CASE WHEN x ->> '$.status' IN ('open', 'needs_owner') THEN x ->> '$.status' ELSE 'open' END}), lambda f: f.claim <> '') AS fs FROM r LEFT JOIN o USING (conv_id, turn)),
 w AS (SELECT *, CASE WHEN o IS NULL THEN 'no JSON object' WHEN o ->> '$.schema_version' <> 'v1' THEN 'other schema version' WHEN said = 'maybe' THEN 'unknown verdict' WHEN said = 'pass' AND len(fs) > 0 THEN 'pass with open findings' WHEN said = 'changes_required' AND len(list_filter(fs, lambda f: f.status = 'open')) = 0 THEN 'changes without an open finding' END AS problem FROM t)
SELECT conv_id, turn, problem, CASE WHEN problem IS NULL THEN said END AS verdict, CASE WHEN problem IS NULL THEN coalesce(list_aggregate(list_transform(fs, lambda f: concat_ws('|', f.id, f.severity, CASE WHEN length(f.claim) > 1200 THEN left(f.claim, 1199) || '…' ELSE f.claim END, f.refs::VARCHAR, f.status)), 'string_agg', ';'), '') END AS findings FROM w""")
def reply_findings(spark, sf_dir):
    d = replies.review_findings(_replies(spark, sf_dir), "reply", "v1")
    line = F.transform("findings", lambda f: F.concat_ws("|", f["finding_id"], f["severity"], f["claim"], F.size(f["evidence_refs"]).cast("string"), f["status"]))
    return d.select("conv_id", "turn", "problem", "verdict", F.when(F.col("findings").isNotNull(), F.concat_ws(";", line)).alias("findings"))


@query("""WITH b AS (SELECT event_id, list_concat([{'u': event_type, 'r': event_id % 5, 'p': event_id % 3}], CASE WHEN event_id % 2 = 0 THEN [{'u': 'pass', 'r': NULL, 'p': 1}] ELSE [] END) AS j FROM events),
 u AS (SELECT event_id, j, unnest(range(len(j))) AS n FROM b)
SELECT event_id, n::INTEGER AS "at", j[n + 1].u AS status, list_filter(list_transform(j, lambda x: x.r::VARCHAR), lambda x: x IS NOT NULL)[n + 1] AS reason, list_filter(list_transform(j, lambda x: CASE WHEN x.p > 0 THEN '/p' || x.p END), lambda x: x IS NOT NULL)[n + 1] AS path FROM u""")
def cut_body_fields(spark, sf_dir):
    """Bodies that break off in the middle of a field; the n-th values of the fields belong together."""
    k = F.col("event_id")
    path = F.when(k % 3 > 0, F.concat(F.lit(',"path": "/p'), k % 3, F.lit('"'))).otherwise("")
    body = F.concat(F.lit('[{"user":"'), F.col("event_type"), F.lit('","reason":"'), k % 5, F.lit('"'), path, F.when(k % 2 == 0, '},{"user" : "pass","path":"/p1","rea').otherwise('},{"us'))
    rows = replies.positional_fields(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", "status", {"status": r'"user"\s*:\s*"([^"]+)"', "reason": r'"reason"\s*:\s*"([^"]*)"', "path": r'"path"\s*:\s*"([^"]+)"'})
    return rows.drop("body")


@query("""SELECT o_orderkey, '{"k":{"' || o_orderkey || '":"' || strftime(o_orderdate, '%Y-%m-%d') || '"},"o":{"at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","n":' || o_custkey || '}}' AS said FROM orders""")
def json_ready_values(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("n"), day.alias("at")).alias("o"), F.create_map("o_orderkey", day).alias("k")).alias("v"))
    return o.select("o_orderkey", F.to_json(replies.json_ready(F.col("v"), o.schema["v"].dataType)).alias("said"))
