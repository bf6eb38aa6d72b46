"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees: each names its parent, or none. Ancestor pointers are doubled by self-joins
(after k of them each message knows its ancestor 2**k steps up, and how many messages and what
score lie between), so a tree of depth n takes about log2(n) joins. Leaves are ranked per tree by
the mean score of their path, then by its length, then by the leaf's id. For the chosen leaves the
pointers are followed down from the longest jump, which names each message of a path once, and each
path becomes one conversation.

The template is `[TURN]role[/TURN]text</s>` and a newline for each turn. Control strings in roles
and texts are broken up by a backslash after their first character and backslashes are doubled, so
no control string of CONTROL is left inside and `parse` gives every text back. The loss mask is a
list of spans (start, length) in code points of the formatted text: the text of each turn whose role
is LEARNED.

A message whose parent is absent is a root. Messages on or below a cycle belong to no path. Null
roles and texts count as empty. Of messages with the same tree and id, the one with the least role
and text is used. Trees whose id is null form a tree of their own; messages with a null id are left
out. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.tables import settle

TURN, ROLE_END, END = "[TURN]", "[/TURN]", "</s>"
#: Fixed strings that tokenizers or chat templates give a meaning.
CONTROL = ("[TURN]", "[/TURN]", "[INST]", "[/INST]", "<s>", "</s>", "<unk>", "<pad>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """Reversibly without any control string."""
    by_first: dict[str, list[str]] = {}
    for c in CONTROL:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    pattern = "|".join(f"{re.escape(c)}(?={'|'.join(rest)})" for c, rest in by_first.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({pattern})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pointers(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Settled tables (tree, node, up, steps, total): level k has the messages that have an ancestor
    2**k steps up, with the number of messages and the sum of scores below it, the node included;
    and the table of those whose path has ended at a root (up is null). A message leaves the
    levels when its path has ended, so long trees cost short ones nothing."""
    ids = messages.select("tree", F.col("node").alias("up"))
    start = messages.select("tree", "node", "parent", "score").join(ids.select("tree", F.col("up").alias("parent"), F.lit(1).alias("there")), ["tree", "parent"], "left")
    start = settle(start.select("tree", "node", F.when(F.col("there").isNotNull(), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.coalesce("score", F.lit(0.0)).alias("total")), "up")
    levels, ended = [start.where("up is not null")], start.where("up is null")
    left = levels[0].count()
    while left:
        now = levels[-1]
        above = ended.unionByName(now).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("s"), F.col("total").alias("t"))
        jumped = settle(now.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("total") + F.col("t")).alias("total")), "up")
        open_rows = jumped.where("up is not null")
        ended = ended.unionByName(jumped.where("up is null"))
        before, left = left, open_rows.count()
        if left == before:  # nothing came nearer to a root: the rest hangs on cycles
            break
        if left:
            levels.append(open_rows)
    return levels, ended


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, rank, leaf, pos, node) of the best-ranked root-to-leaf paths of each tree, from
    messages (tree, node, parent, score)."""
    levels, ended = _pointers(messages)
    parents = levels[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = ended.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("steps")).desc(), F.col("steps").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    found = chosen.select("tree", "rank", F.col("node").alias("leaf"), (F.col("steps") - 1).alias("pos"), "node")
    jump = 1 << len(levels)
    for level in reversed(levels):
        jump >>= 1
        up = level.select("tree", "node", "up")
        both = F.explode(F.filter(F.array(F.struct("node", "pos"), F.struct(F.col("up").alias("node"), (F.col("pos") - jump).alias("pos"))), lambda x: x["node"].isNotNull()))
        found = found.join(up, ["tree", "node"], "left").select("tree", "rank", "leaf", both.alias("at")).select("tree", "rank", "leaf", "at.pos", "at.node")
    return settle(found, "paths")


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """One row for each chosen path: tree, rank, leaf, n_turns, formatted, loss (array of start and
    length in code points), from messages (tree, node, parent, score, role, text)."""
    key = F.to_json(F.struct("tree"))  # never null, so that a null tree is a tree
    names = messages.select("tree", key.alias("key")).distinct()
    kept = messages.where(F.col("node").isNotNull()).select(key.alias("tree"), "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = kept.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "node", "m.*")
    kept = settle(kept, "messages")
    turns = paths(kept, best).join(kept.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(ROLE_END))
    body = escaped(F.col("text"))
    turns = turns.select("tree", "rank", "leaf", "pos", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(END) + 1
    before = Window.partitionBy("tree", "rank", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    piece = F.struct("pos", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "start", F.length("body").cast("long").alias("length"), (F.col("role") == LEARNED).alias("learned"))
    rows = turns.groupBy("tree", "rank", "leaf").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    out = rows.select(F.col("tree").alias("key"), "rank", "leaf", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))
    return out.join(names, "key").select("tree", "rank", "leaf", "n_turns", "formatted", "loss")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    pieces = F.filter(F.split(formatted, re.escape(END) + "\n"), lambda x: x != "")
    role = lambda x: unescaped(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), ROLE_END, 1))
    text = lambda x: unescaped(F.substr(x, F.instr(x, ROLE_END) + len(ROLE_END)))
    return F.transform(pieces, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear(rows: DataFrame, tree: str, turn: str) -> DataFrame:
    """Plain conversations as trees: each turn is the reply to the one before."""
    order = Window.partitionBy(tree).orderBy(turn, "role", "text")
    m = rows.withColumn("__n", F.row_number().over(order).cast("long"))
    return m.select(F.col(tree).alias("tree"), F.col("__n").alias("node"), F.when(F.col("__n") > 1, F.col("__n") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
