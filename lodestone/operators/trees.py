"""Trees by pointer doubling: ancestors, depth-first order with intervals, navigators, threads.

A chain of n steps takes log2(n) joins, whatever the shape of the tree. The depth-first order comes from
an Euler tour: each node is entered and left, each of these events names the next one, and doubling
counts the events up to the end. A node's row and the row of its last descendant are an interval that
holds its descendants' rows, so that what is below something needs no further walk. Brothers and sisters
are sorted by range, so a parent of very many children is no single task either.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import cut
from lodestone.operators.ordered import positions

#: Kinds of nodes in the order in which they stand under a parent. Fixed values.
TYPES = ["mainline", "decision", "next", "artifact", "question", "branch", "parked"]
BLOCK = 4096
#: Levels up to which a navigator keeps paths; children from which on a parent's are sorted by several tasks.
DEEP, WIDE = 64, 100_000


def known_parent(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """`nodes` with a parent that is absent from the table, or the node itself, as null."""
    ids = nodes.select(F.col(node).alias("__p")).distinct()
    rows = nodes.join(ids, (F.col(parent) == F.col("__p")) & (F.col(parent) != F.col(node)), "left")
    return rows.withColumn(parent, F.col("__p")).drop("__p")


def ancestry(nodes: DataFrame, node: str, parent: str, index: str) -> DataFrame:
    """(node, top, steps, least, cyclic): the topmost ancestor and the steps to it, the least index of the
    node and its ancestors, and whether they form a cycle (then top and steps mean nothing). Ids are
    unique and not null; parents are in the table or null."""
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.coalesce(parent, node).alias("top"), F.col(parent).isNotNull().cast("long").alias("steps"), F.col(index).alias("least"))
    rows = cut(rows)
    n = rows.count()
    for _ in range(ceil(log2(max(n, 2))) + 1):
        if not rows.where("up is not null").take(1):
            break
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("top").alias("__top"), F.col("steps").alias("__steps"), F.col("least").alias("__least"))
        far = rows.where("up is not null").join(above, "up").select("node", F.col("__up").alias("up"), F.col("__top").alias("top"), (F.col("steps") + F.col("__steps")).alias("steps"), F.least("least", "__least").alias("least"))
        rows = cut(rows.where("up is null").unionByName(far))
    return rows.select("node", "top", "steps", "least", F.col("up").isNotNull().alias("cyclic"))


def layout(nodes: DataFrame, node: str, parent: str, rank: list[str], index: str, cycles: bool = True) -> DataFrame:
    """(node, parent, depth, row, last): depth-first order, children by `rank`, then index; `last` is the
    row of the last descendant. Roots are nodes whose parent is absent, or themselves. Nodes on or below
    a cycle come after all others, each part from its node with the least index on the way up; without
    `cycles` they are left out. Rows without an id are left out; ids and indexes are unique."""
    rows = known_parent(nodes.where(F.col(node).isNotNull()), node, parent)
    up = ancestry(rows, node, parent, index)
    rows = rows.join(up.select(F.col("node").alias("__n"), "least", "cyclic"), F.col(node) == F.col("__n"))
    if not cycles:
        rows = rows.where("not cyclic")
    opened = F.col("cyclic") & (F.col("least") == F.col(index))
    keys = [f"__r{k}" for k in range(len(rank))]
    rows = rows.select(F.col(node).alias("node"), F.when(~opened, F.col(parent)).alias("parent"), opened.alias("__late"), *(F.when(~opened, F.col(c)).alias(k) for c, k in zip(rank, keys, strict=True)), F.col(index).alias("__index"))
    rows = cut(positions(rows, "parent", ["__late", *keys, "__index"]).select("node", "parent", "__i"))
    first = rows.where("__i = 0 and parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("first"))
    after = rows.select("parent", (F.col("__i") - 1).alias("__i"), F.col("node").alias("after"))
    enter = rows.join(first, "node", "left").select("node", F.lit(0).alias("k"), F.coalesce("first", "node").alias("nn"), F.when(F.col("first").isNull(), 1).otherwise(0).alias("nk"))
    left = rows.alias("a").join(after.alias("b"), F.col("a.parent").eqNullSafe(F.col("b.parent")) & (F.col("a.__i") == F.col("b.__i")), "left")
    leave = left.select("a.node", F.lit(1).alias("k"), F.coalesce("b.after", "a.parent").alias("nn"), F.when(F.col("b.after").isNull(), 1).otherwise(0).alias("nk"))
    tour = cut(enter.unionByName(leave).withColumns({"enters": (1 - F.col("k")).cast("long"), "leaves": F.col("k").cast("long")}))
    total = tour.count() // 2
    for _ in range(ceil(log2(max(2 * total, 2)))):
        step = tour.select(F.col("node").alias("nn"), F.col("k").alias("nk"), F.col("nn").alias("__nn"), F.col("nk").alias("__nk"), F.col("enters").alias("__e"), F.col("leaves").alias("__l"))
        open_ = tour.where("nn is not null").join(step, ["nn", "nk"]).select("node", "k", F.col("__nn").alias("nn"), F.col("__nk").alias("nk"), (F.col("enters") + F.col("__e")).alias("enters"), (F.col("leaves") + F.col("__l")).alias("leaves"))
        tour = cut(tour.where("nn is null").unionByName(open_))
    # counts from an event to the end: entered at `row`, and left after the last descendant
    sides = tour.groupBy("node").agg(F.max(F.when(F.col("k") == 0, F.col("enters"))).alias("e"), F.max(F.when(F.col("k") == 0, F.col("leaves"))).alias("l"), F.max(F.when(F.col("k") == 1, F.col("enters"))).alias("x"))
    placed = sides.select("node", (F.col("l") - F.col("e")).alias("depth"), (F.lit(total) - F.col("e")).alias("row"), (F.lit(total) - F.col("x") - 1).alias("last"))
    return rows.select("node", "parent").join(placed, "node")


def below(placed: DataFrame, marked: DataFrame) -> DataFrame:
    """The nodes of a layout that are marked (column node) or stand below a marked one. A running maximum
    of the marked intervals' ends over the rows: inside blocks of rows, and over one row a block."""
    rows = placed.join(marked.select("node").distinct().withColumn("__m", F.lit(1)), "node", "left").select("node", "row", F.when(F.col("__m") == 1, F.col("last")).alias("__end"))
    rows = rows.withColumn("__b", F.floor(F.col("row") / BLOCK))
    blocks = rows.groupBy("__b").agg(F.max("__end").alias("__top"))
    before = F.max("__top").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("__b", before.alias("__before"))
    inside = F.max("__end").over(Window.partitionBy("__b").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__inside", inside).join(blocks, "__b")
    return rows.where(F.coalesce(F.greatest("__inside", "__before") >= F.col("row"), F.lit(False))).select("node")


def _clean(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def navigator(nodes: DataFrame, expanded: list[str] | None = None, deep: int = DEEP) -> DataFrame:
    """(id, kind, parent, relation, depth, row, child_count) of a navigator. Nodes have id, parent,
    branch_from, type, card and index (their place in the source). A node stands under its parent, else
    under what it branches from. Artifacts of one card under one parent are a group if they are two or more
    and not expanded (`parent::card`): one row stands for them, and they and all below them are hidden.
    Nodes on cycles, also those under themselves, are under no root and left out. Trees of at most `deep`
    levels without cycles are walked by paths, which costs a few shuffles of the nodes; others by a tour."""
    rows = nodes.select("id", F.coalesce(_clean("parent"), _clean("branch_from")).alias("up"), _clean("parent").isNotNull().alias("own"), _clean("type").alias("type"), _clean("card").alias("card"), "index").where("id is not null")
    at = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    rows = cut(rows.withColumn("value", F.when(at > 0, at - 1).otherwise(99) * 1000 + F.col("index")))
    key = F.concat(F.coalesce("up", F.lit("")), F.lit("::"), F.col("card"))
    artifacts = rows.where("type = 'artifact' and card is not null").select("id", "up", key.alias("key"))
    groups = artifacts.groupBy("key").agg(F.count("*").alias("n"), F.first("up").alias("up"))
    groups = cut(groups.where((F.col("n") > 1) & ~F.col("key").isin(expanded or [])))
    members = artifacts.join(groups.select("key").hint("merge"), "key").select(F.col("id").alias("node"), "key")
    walked = _paths(rows, members, deep)
    if walked is None:
        walked = _toured(rows, members)
    placed, shown = walked.select("node", "pos"), walked.where("not hid")
    relation = F.when(F.col("parent").isNotNull(), F.when(F.col("own"), "parent").otherwise("branch_from"))
    one = shown.select(F.col("node").alias("id"), F.lit("node").alias("kind"), "parent", relation.alias("relation"), "depth", F.col("pos").alias("__pos"), F.col("n").alias("child_count"))
    first = members.join(placed.hint("merge"), "node").groupBy("key").agg(F.min("pos").alias("__pos"))
    over = groups.join(first.hint("merge"), "key").join(shown.select(F.col("node").alias("up"), "depth").hint("merge"), "up")
    many = over.select(F.concat(F.lit("artifact-group:"), "key").alias("id"), F.lit("artifact_group").alias("kind"), F.col("up").alias("parent"), F.lit("artifact_group").alias("relation"), (F.col("depth") + 1).alias("depth"), "__pos", F.col("n").alias("child_count"))
    numbered = positions(one.unionByName(many).withColumn("__all", F.lit(0)), "__all", ["__pos"])
    return numbered.select("id", "kind", "parent", "relation", "depth", F.col("__i").alias("row"), "child_count")


def _code(i: Column) -> Column:
    """A number of 0 or more as bytes that sort as it does, none of which begins another's."""
    h = F.hex(i)
    even = F.lpad(h, F.length(h) + F.length(h) % 2, F.lit("0"))
    return F.unhex(F.when(i < 192, F.lpad(h, 2, "0")).otherwise(F.concat(F.hex(192 + F.length(even) / 2), even)))


def _paths(rows: DataFrame, members: DataFrame, deep: int) -> DataFrame | None:
    """(node, parent, own, n, depth, pos, hid): n children; pos, the places among brothers and sisters from
    the root down, whose bytes sort in depth-first order; hid, whether the node or an ancestor is one of
    the members. None if a node has over `deep` ancestors or is on or below a cycle. Paths are joined from
    both halves, so that there are log2(deep) rounds, and only nodes with children are joined to.
    Joins are merges: by the few bytes of these rows on disk Spark would broadcast them."""
    counts = rows.where("up is not null").groupBy(F.col("up").alias("__up")).agg(F.count("*").alias("n"))
    hidden = members.select(F.col("node").alias("__m"), F.lit(True).alias("hid"))
    known = rows.select("id", "up", "own", "value", "index").join(counts.hint("merge"), F.col("id") == F.col("__up"), "left").join(hidden.hint("merge"), F.col("id") == F.col("__m"), "left")
    known = cut(known.select("id", "up", "own", "value", "index", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hid", F.lit(False)).alias("hid"), F.monotonically_increasing_id().alias("num")))
    children = known.where("up is not null").select("num", "up", "value", "index", "hid", (F.col("n") > 0).alias("inner"))
    wide = cut(counts.where(F.col("n") > WIDE).select(F.col("__up").alias("up")))  # few: each has many children
    parents = known.where("n > 0").select(F.col("id").alias("up"), F.col("num").alias("above"))
    brothers = F.row_number().over(Window.partitionBy("up").orderBy("value", "index")) - 1
    met = children.join(F.broadcast(wide), "up", "left_anti").join(parents.hint("merge"), "up", "left").withColumn("__i", brothers.cast("long"))
    if wide.take(1):
        most = positions(children.join(F.broadcast(wide), "up", "left_semi"), "up", ["value", "index"])
        met = met.unionByName(most.join(F.broadcast(parents.join(F.broadcast(wide), "up", "left_semi")), "up", "left"))
    met = cut(met)
    kids = met.where("above is not null").select("num", "above", _code(F.col("__i")).alias("pos"), F.lit(1).alias("depth"), "hid", "inner")
    roots = known.where("up is null").select("num", "value", "index", "hid", (F.col("n") > 0).alias("inner")).unionByName(met.where("above is null").select("num", "value", "index", "hid", "inner"))
    roots = positions(roots.withColumn("__all", F.lit(0)), "__all", ["value", "index"])
    done = cut(roots.select("num", F.lit(None).cast("long").alias("above"), _code(F.col("__i")).alias("pos"), F.lit(0).alias("depth"), "hid", "inner"))
    open_ = kids
    for _ in range(ceil(log2(deep))):
        if not open_.take(1):
            break
        over = done.unionByName(open_).where("inner").select(F.col("num").alias("above"), F.col("above").alias("__a"), F.col("pos").alias("__p"), F.col("depth").alias("__d"), F.col("hid").alias("__h"))
        far = open_.join(over.hint("merge"), "above").select("num", F.col("__a").alias("above"), F.concat("__p", "pos").alias("pos"), (F.col("depth") + F.col("__d")).alias("depth"), (F.col("hid") | F.col("__h")).alias("hid"), "inner")
        far = cut(far)
        done, open_ = done.unionByName(far.where("above is null")), far.where("above is not null")
    else:
        if open_.take(1):
            return None
    told = known.select("num", F.col("id").alias("node"), F.col("up").alias("parent"), "own", "n")
    walked = done.select("num", F.col("depth").cast("long").alias("depth"), "pos", "hid").join(told.hint("merge"), "num").drop("num")
    return cut(walked.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))))


def _toured(rows: DataFrame, members: DataFrame) -> DataFrame:
    """What `_paths` gives, of trees of any depth and without what is on or below a cycle; pos is the row."""
    placed = cut(layout(rows, "id", "up", ["value"], "index", cycles=False))
    own_parent = rows.where("up = id").select(F.col("id").alias("node"))  # the shortest cycle
    hidden = below(placed, members.select("node").unionByName(own_parent)).withColumn("hid", F.lit(True))
    children = placed.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    told = placed.join(hidden, "node", "left").join(children, "node", "left").join(rows.select(F.col("id").alias("node"), "own"), "node")
    return cut(told.select("node", "parent", "own", F.coalesce("n", F.lit(0)).alias("n"), "depth", F.col("row").alias("pos"), F.coalesce("hid", F.lit(False)).alias("hid")))


def thread_depths(entries: DataFrame, run: str, parent: str, index: str, most: int = 100) -> DataFrame:
    """(run, depth, mainline): how many forks lead to an entry, `most` and one at most, also on cycles. A
    parent that is not in the table counts as a fork, and the entry is of the main line, as is one
    without a parent. Blank parents are none; run ids are unique."""
    rows = entries.where(F.col(run).isNotNull()).select(F.col(run).alias("run"), _clean(parent).alias("said"), F.col(index).alias("index"))
    ids = rows.select(F.col("run").alias("__p")).distinct()
    rows = cut(rows.join(ids, F.col("said") == F.col("__p"), "left").withColumnRenamed("__p", "up"))
    chain = ancestry(rows, "run", "up", "index")
    tops = rows.select(F.col("run").alias("top"), F.col("said").isNotNull().cast("long").alias("__more"))
    depth = F.when(F.col("cyclic"), most + 1).otherwise(F.least(F.col("steps") + F.col("__more"), F.lit(most + 1)))
    made = chain.join(tops, "top", "left").select(F.col("node").alias("run"), depth.cast("long").alias("depth"))
    return made.join(rows.select("run", F.col("up").isNull().alias("mainline")), "run")
