"""Trees against plain walks: random forests with cycles, orphans and deep chains."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import trees


def walked(nodes):
    """node -> (depth, row) by a plain depth-first walk; what is on a cycle is visited last."""
    ids = {n for n, *_ in nodes}
    children, roots = {}, []
    for n, p, rank, i in nodes:
        if p in ids and p != n:
            children.setdefault(p, []).append((rank, i, n))
        else:
            roots.append((rank, i, n))
    out, order = {}, sorted(roots) + sorted((0, i, n) for n, _, _, i in nodes)
    for _, _, root in order:
        stack = [(root, 0)]
        while stack:
            n, d = stack.pop()
            if n not in out:
                out[n] = (d, len(out))
                stack += [(c, d + 1) for _, _, c in sorted(children.get(n, []), reverse=True)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_layout(spark, seed):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(120)]
    nodes = [(n, r.choice([None, "gone", n, *r.sample(names, 4), names[max(0, k - 1)], names[max(0, k - 1)]]), r.randrange(3), k) for k, n in enumerate(names)]
    d = spark.createDataFrame(nodes, "id string, up string, rank int, at int").repartition(3)
    got = trees.layout(d, "id", "up", ["rank"], "at").collect()
    expected = walked(nodes)
    assert {x.node: (x.depth, x.row) for x in got} == expected
    ends = {x.node: x["last"] for x in got}
    up = {x.node: x.parent for x in got}
    for n in names:
        p = n
        while p:
            assert expected[p][1] <= expected[n][1] <= ends[p]
            p = up[p]
    cyclic = {x.node for x in trees.ancestry(trees.known_parent(d, "id", "up"), "id", "up", "at").collect() if x.cyclic}
    assert {x.node for x in trees.layout(d, "id", "up", ["rank"], "at", cycles=False).collect()} == set(names) - cyclic


def test_deep_chain_and_nothing(spark):
    d = spark.createDataFrame([(k, k - 1 if k else None, 0, k) for k in range(300)], "id long, up long, rank int, at int")
    assert {(x.node, x.depth, x.row, x["last"]) for x in trees.layout(d, "id", "up", ["rank"], "at").collect()} == {(k, k, k, 299) for k in range(300)}
    assert trees.layout(d.limit(0), "id", "up", ["rank"], "at").count() == 0


def plain_navigator(nodes, expanded):
    clean = lambda x: (x or "").strip()
    up = lambda n: clean(n[1]) or clean(n[2])
    ids = {n[0]: n for n in nodes}
    value = lambda n: ((trees.TYPES.index(clean(n[3])) if clean(n[3]) in trees.TYPES else 99) * 1000 + n[5], n[5])
    key = lambda n: f"{up(n)}::{clean(n[4])}" if clean(n[3]) == "artifact" and clean(n[4]) else ""
    children, groups, child_ids = {}, {}, set()
    for n in nodes:
        if up(n) in ids:
            children.setdefault(up(n), []).append(n)
            child_ids.add(n[0])
        if key(n):
            groups.setdefault(key(n), []).append(n)
    closed = {k for k, v in groups.items() if len(v) > 1 and k not in expanded}
    hidden = {n[0] for n in nodes if key(n) in closed}
    todo = list(hidden)
    while todo:
        for c in children.get(todo.pop(), []):
            if c[0] not in hidden:
                hidden.add(c[0])
                todo.append(c[0])
    out = []

    def visit(n, depth):
        if n[0] in hidden:
            return
        parent = up(n) if n[0] in child_ids else None
        out.append((n[0], "node", parent, ("parent" if clean(n[1]) else "branch_from") if parent else None, depth, len(out), len(children.get(n[0], []))))
        seen = set()
        for c in sorted(children.get(n[0], []), key=value):
            if key(c) in closed:
                if key(c) not in seen:
                    seen.add(key(c))
                    out.append((f"artifact-group:{key(c)}", "artifact_group", n[0], "artifact_group", depth + 1, len(out), len(groups[key(c)])))
                continue
            visit(c, depth + 1)

    for n in sorted((n for n in nodes if n[0] not in child_ids), key=value):
        visit(n, 0)
    return out


@pytest.mark.parametrize("expanded", [[], ["n3::card1", "n0::card0"]])
def test_navigator(spark, expanded):
    r = random.Random(7)
    nodes = [(f"n{k}", r.choice([None, " ", f"n{r.randrange(max(1, k))}", f"n{r.randrange(max(1, k))}", "gone"]) if k else None, r.choice([None, f"n{r.randrange(k + 1)}"]), r.choice([*trees.TYPES, "artifact", "artifact", "odd", None]), r.choice(["card0", "card1", None, ""]), k) for k in range(90)]
    nodes += [("x", "y", None, "next", None, 90), ("y", "x", None, "next", None, 91), ("n92", "x", None, None, None, 92)]
    d = spark.createDataFrame(nodes, "id string, parent string, branch_from string, type string, card string, index int").repartition(3)
    got = trees.navigator(d, expanded).orderBy("row").collect()
    assert [tuple(x) for x in got] == plain_navigator(nodes, set(expanded))


@pytest.mark.parametrize(("deep", "wide"), [(64, 3), (4, 100_000)])
def test_navigator_by_paths(spark, monkeypatch, deep, wide):
    """Without cycles; a chain of 20 is deeper than 4, and over 200 roots have places of two bytes."""
    monkeypatch.setattr(trees, "WIDE", wide)
    r = random.Random(11)
    nodes = [(f"n{k}", r.choice([None, f"n{r.randrange(max(1, k))}", "gone"]) if k else None, None, r.choice([*trees.TYPES, "artifact", "artifact", "odd", None]), r.choice(["card0", "card1", None]), k) for k in range(400)]
    nodes += [(f"c{k}", f"c{k - 1}" if k else None, None, "next", None, 600 + k) for k in range(20)] + [(f"m{k}", "c0", None, "next", None, 700 + k) for k in range(250)]
    d = spark.createDataFrame(nodes, "id string, parent string, branch_from string, type string, card string, index int").repartition(3)
    got = trees.navigator(d, ["n0::card0"], deep).orderBy("row").collect()
    assert [tuple(x) for x in got] == plain_navigator(nodes, {"n0::card0"})


def test_navigator_shuffles_nodes_a_few_times(spark):
    """A tour of the nodes was shuffled and written again in each of its rounds."""
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    k = F.col("id")
    d = spark.range(6000).repartition(3).select(F.concat(F.lit("n"), k).alias("id"), F.when(k > 0, F.concat(F.lit("n"), F.floor(k / 3))).alias("parent"), F.lit(None).cast("string").alias("branch_from"), F.lit("next").alias("type"), F.lit(None).cast("string").alias("card"), k.alias("index"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of larger tables
    try:
        before = written()
        assert trees.navigator(d).count() == 6000
        assert written() - before < 2_500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_thread_depths(spark):
    r = random.Random(2)
    rows = [(f"r{k}", r.choice([None, "", "gone", f"r{r.randrange(max(1, k))}", f"r{max(0, k - 1)}"]) if k else None, k) for k in range(60)] + [(f"d{k}", f"d{k - 1}" if k else None, 100 + k) for k in range(130)] + [("a", "b", 500), ("b", "a", 501)]
    by = {n: p for n, p, _ in rows}

    def depth(n):
        if not by[n]:
            return 0
        d, cur, guard = 1, by[n], 0
        while cur in by and by[cur] and guard < 100:
            d, cur, guard = d + 1, by[cur], guard + 1
        return d

    got = trees.thread_depths(spark.createDataFrame(rows, "run string, parent string, at int"), "run", "parent", "at").collect()
    assert {x.run: (x.depth, x.mainline) for x in got} == {n: (depth(n), by[n] not in by) for n, *_ in rows}
