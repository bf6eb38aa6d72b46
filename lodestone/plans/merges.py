"""Queries of operations that are checked and applied to comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import operations
from lodestone.plans.catalogue import query, table

_ACTIONS = ["create", "update", "update", "withdraw", "keep", "candidate_resolved"]
_SOURCES_SQL = f"""c AS (SELECT 'k' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 's:F' || (c_custkey % 50) END AS skey, c_custkey % 4 = 0 AS human, CASE WHEN c_custkey % 5 = 0 THEN 'person' ELSE 'ai-review' END AS source, (1 + c_custkey % 3)::BIGINT AS version FROM customer),
 o AS (SELECT 'e' || event_id AS op, event_id AS place, {_ACTIONS}[1 + event_id % 6] AS action, 'F' || (event_id % 60) AS finding, 'k' || user_id AS target, CASE WHEN event_id % 7 > 0 THEN 'text ' || (event_id % 4) END AS proposed, CASE WHEN event_id % 2 = 0 THEN 'resurfaced' END AS transition FROM events)"""


def _comments(spark, sf_dir):
    k = F.col("c_custkey")
    known = {"source_key": F.when(k % 3 == 0, F.concat(F.lit("s:F"), (k % 50).cast("string"))), "human_edited": k % 4 == 0, "source": F.when(k % 5 == 0, "person").otherwise("ai-review"), "comment_version": 1 + k % 3}
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), k.cast("string")).alias("id"), *(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in operations.COMMENT.items()))


def _operations(spark, sf_dir):
    k = F.col("event_id")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(text("e", k).alias("operation_id"), k.alias("place"), action.alias("action"), text("F", k % 60).alias("finding_id"), text("k", F.col("user_id")).alias("target_id"), F.when(k % 7 > 0, text("text ", k % 4)).alias("proposed"), F.when(k % 2 == 0, "resurfaced").alias("transition"), F.lit("").alias("reason"), (k % 5 > 0).alias("verified"), F.when(k % 4 > 0, "proof").alias("resolution"))


@query(f"""WITH {_SOURCES_SQL}, t AS (SELECT o.*, c.id IS NOT NULL AS there, coalesce(human, false) AS human, source FROM o LEFT JOIN c ON c.id = target),
 a AS (SELECT *, CASE WHEN action IN ('create', 'update') AND proposed IS NULL THEN 'blocked' WHEN action IN ('create', 'update') AND place % 5 = 0 THEN 'keep' WHEN action = 'candidate_resolved' AND (NOT there OR human OR source <> 'ai-review' OR place % 4 = 0) THEN 'blocked' ELSE action END AS act,
 CASE WHEN action IN ('create', 'update') AND proposed IS NULL THEN 'proposed comment failed validation' WHEN action IN ('create', 'update') AND place % 5 = 0 THEN 'evidence_unverified' WHEN action = 'candidate_resolved' THEN CASE WHEN NOT there THEN 'target comment does not exist' WHEN human OR source <> 'ai-review' THEN 'candidate_resolved cannot close human-controlled finding' WHEN place % 4 = 0 THEN 'candidate_resolved requires explicit before/after/new evidence' ELSE '' END ELSE '' END AS why FROM t)
SELECT op AS operation_id, CASE WHEN act IN ('update', 'withdraw', 'keep') AND NOT there THEN 'blocked' ELSE act END AS action, CASE WHEN act IN ('update', 'withdraw', 'keep') AND NOT there AND why = '' THEN 'target comment does not exist' ELSE why END AS reason FROM a""")
def checked_operations(spark, sf_dir):
    """Events as operations on customers' comments: what may be done, and why not."""
    return operations.checked(_operations(spark, sf_dir), _comments(spark, sf_dir)).select("operation_id", "action", "reason")


@query(f"""WITH RECURSIVE {_SOURCES_SQL}, by_key AS (SELECT skey, max(id) AS id FROM c WHERE skey IS NOT NULL GROUP BY skey),
 e AS (SELECT o.*, CASE WHEN action = 'create' THEN coalesce(by_key.id, 'c-' || left(sha256('s:' || finding), 16)) ELSE target END AS id FROM o LEFT JOIN by_key ON skey = 's:' || finding),
 n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS k FROM e),
 fold AS (SELECT i.id, 0::BIGINT AS k, c.id IS NOT NULL AS here, skey, NULL::VARCHAR AS fstate, human, source, version, NULL::VARCHAR AS sig, NULL::VARCHAR AS op, NULL::VARCHAR AS outcome, 0::BIGINT AS from_version FROM (SELECT DISTINCT id FROM e) i LEFT JOIN c USING (id)
 UNION ALL
 SELECT id, k, here OR writes, CASE WHEN outcome IN ('created', 'updated', 'withdrawn') THEN key ELSE skey END, CASE outcome WHEN 'created' THEN 'accepted' WHEN 'updated' THEN 'accepted' WHEN 'withdrawn' THEN 'withdrawn' ELSE fstate END, CASE WHEN outcome = 'created' THEN false ELSE human END,
  CASE WHEN outcome IN ('created', 'updated') THEN coalesce(source, 'ai-review') ELSE source END, CASE WHEN outcome = 'created' THEN 1 WHEN writes THEN version + 1 ELSE version END, CASE WHEN writes THEN sg ELSE sig END, op, outcome, CASE WHEN here THEN version ELSE 0 END
 FROM (SELECT *, outcome IN ('created', 'updated', 'withdrawn', 'candidate_resolved') OR (outcome = 'kept' AND here AND transition IS NOT NULL AND proposed IS NOT NULL) AS writes FROM (SELECT *, CASE action
   WHEN 'create' THEN CASE WHEN NOT here THEN 'created' WHEN same THEN 'skipped' ELSE 'conflict' END
   WHEN 'update' THEN CASE WHEN NOT here THEN 'conflict' WHEN same THEN 'skipped' ELSE 'updated' END
   WHEN 'withdraw' THEN CASE WHEN NOT here THEN 'conflict' WHEN same AND fstate = 'withdrawn' THEN 'skipped' ELSE 'withdrawn' END
   WHEN 'keep' THEN 'kept' ELSE CASE WHEN NOT here OR human OR source <> 'ai-review' THEN 'conflict' ELSE 'candidate_resolved' END END AS outcome
  FROM (SELECT *, CASE WHEN action IN ('create', 'update') AND proposed IS NOT NULL THEN 'P' || proposed ELSE action || '|' || finding || '|' || key || '|' || target END AS sg, here AND coalesce(skey = key AND sig = sg, false) AS same
   FROM (SELECT f.* EXCLUDE (k, op, outcome, from_version), n.k, n.op, n.action, n.finding, n.target, n.proposed, n.transition, CASE WHEN f.here AND f.skey IS NOT NULL THEN f.skey ELSE 's:' || n.finding END AS key FROM fold f JOIN n ON n.id = f.id AND n.k = f.k + 1)))))
SELECT op AS operation_id, id, outcome, from_version, CASE WHEN here THEN version ELSE 0 END AS to_version FROM fold WHERE k > 0""")
def applied_operations(spark, sf_dir):
    """What each operation does to its comment, in their order, and the versions before and after."""
    merged = operations.folded(_comments(spark, sf_dir), _operations(spark, sf_dir), "run", "s")
    return operations.outcomes(merged).drop("reason")
