"""Queries of trees: depth-first rows with intervals, a navigator with collapsed groups, threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import trees
from lodestone.plans.catalogue import query, table


@query("""WITH t AS (SELECT 'r' || r_regionkey AS node, 0 AS depth, [r_regionkey] AS path FROM region
 UNION ALL SELECT 'n' || n_nationkey, 1, [n_regionkey, n_nationkey] FROM nation
 UNION ALL SELECT 'c' || c_custkey, 2, [n_regionkey, n_nationkey, c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey),
 s AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS row_ FROM t),
 below AS (SELECT a.node, count(*) AS n FROM s a JOIN s b ON b.path[1:len(a.path)] = a.path GROUP BY a.node)
SELECT node, depth::BIGINT AS depth, row_ AS "row", row_ + n - 1 AS "last" FROM s JOIN below USING (node)""")
def tree_rows(spark, sf_dir):
    """Regions, nations and customers in depth-first order, each with the rows of all below it."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up"), F.col("r_regionkey").cast("long").alias("at"))
    n = table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("node"), named("r", "n_regionkey").alias("up"), (F.col("n_nationkey") + 10).cast("long").alias("at"))
    c = table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("node"), named("n", "c_nationkey").alias("up"), (F.col("c_custkey") + 1000).cast("long").alias("at"))
    return trees.layout(r.unionByName(n).unionByName(c), "node", "up", [], "at").select("node", "depth", "row", "last")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 > 0 THEN o_orderkey // 3 END AS up, o_orderkey * 7 % 8 AS t, CASE WHEN o_orderkey % 4 > 0 THEN 'card' || (o_orderkey % 4) END AS card FROM orders),
 v AS (SELECT *, CASE WHEN t < 7 THEN t ELSE 99 END * 1000 + k AS value, CASE WHEN t = 3 AND card IS NOT NULL THEN coalesce('o' || up, '') || '::' || card END AS key FROM n),
 g AS (SELECT key, any_value(up) AS up, count(*) AS n FROM v WHERE key IS NOT NULL AND key <> 'o1::card1' GROUP BY key HAVING count(*) > 1),
 w AS (SELECT k, 0 AS depth, [value, k] AS path, key IN (SELECT key FROM g) AS hid FROM v WHERE up IS NULL
 UNION ALL SELECT v.k, depth + 1, list_concat(path, [v.value, v.k]), hid OR coalesce(v.key IN (SELECT key FROM g), false) FROM w JOIN v ON v.up = w.k),
 c AS (SELECT up AS k, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
 r AS (SELECT 'o' || w.k AS id, 'node' AS kind, 'o' || v.up AS parent, CASE WHEN v.up IS NULL THEN NULL WHEN w.k % 2 = 0 THEN 'parent' ELSE 'branch_from' END AS relation, depth, path, coalesce(c.n, 0) AS child_count FROM w JOIN v USING (k) LEFT JOIN c ON c.k = w.k WHERE NOT coalesce(hid, false)
 UNION ALL SELECT 'artifact-group:' || key, 'artifact_group', 'o' || g.up, 'artifact_group', any_value(p.depth) + 1, min(m.path), any_value(g.n) FROM g JOIN v USING (key) JOIN w m ON m.k = v.k JOIN w p ON p.k = g.up WHERE NOT coalesce(p.hid, false) GROUP BY key, g.up)
SELECT id, kind, parent, relation, depth::BIGINT AS depth, row_number() OVER (ORDER BY path) - 1 AS "row", child_count FROM r""")
def navigator_rows(spark, sf_dir):
    """Orders as nodes, each under the one of a third of its number; artifacts of a card are one row."""
    k = F.col("o_orderkey")
    up = F.when(k % 17 > 0, F.concat(F.lit("o"), F.floor(k / 3).cast("string")))
    kind = F.element_at(F.array(*map(F.lit, [*trees.TYPES, "other"])), (k * 7 % 8 + 1).cast("int"))
    nodes = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), k.cast("string")).alias("id"), F.when(k % 2 == 0, up).alias("parent"), up.alias("branch_from"), kind.alias("type"), F.when(k % 4 > 0, F.concat(F.lit("card"), (k % 4).cast("string"))).alias("card"), k.alias("index"))
    return trees.navigator(nodes, ["o1::card1"])


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 3 THEN -1 ELSE o_orderkey // 2 END AS up FROM orders),
 w AS (SELECT k, CASE WHEN up IS NULL THEN 0 ELSE 1 END AS depth, true AS mainline FROM n WHERE up IS NULL OR up = -1
 UNION ALL SELECT n.k, depth + 1, false FROM w JOIN n ON n.up = w.k)
SELECT 'r' || k AS run, depth::BIGINT AS depth, mainline FROM w""")
def thread_depths(spark, sf_dir):
    k = F.col("o_orderkey")
    parent = F.when(k % 5 == 0, "").when(k % 11 == 3, "gone").otherwise(F.concat(F.lit("r"), F.floor(k / 2).cast("string")))
    runs = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), k.cast("string")).alias("run"), parent.alias("parent"), k.alias("at"))
    return trees.thread_depths(runs, "run", "parent", "at")
