"""Cheapest repair of a conversation's structure, as a shortest path.

A row is kept (0), given another role (3) or deleted (4), and rows without text can be put in anywhere
(3); a truncated row that stays costs 3 more, and a blank or repeated row must go. The roles of what is
left must have initials `(s?(ua)+)?`. Nodes are (rows read, state of that pattern), arcs the edits. As
costs are small whole numbers, a bucket queue (Dial) settles the distances to the end; the audit then
walks from the start along tight arcs, always by the least initial of Delete, Insert, Keep, Rerole. In a
state each edit leads to one node, so the walk is the least of all cheapest audits.

Conversations of up to `long_rows` rows and `long_bytes` bytes are dealt by id, sorted and streamed, one
at a time in memory. Longer ones are sorted by range over all tasks and cut into segments of at most
`segment` rows. Each segment is reduced to its distances between states (4 x 4), one task a
conversation folds these small tables into the distances at the cuts, and each segment then walks on
its own from the state in which the one before it ends. Only the digest of a repaired conversation
reads it in order, as a digest must; it streams the segments and holds the audit, which is the result.

Defined results: null roles and texts count as one space; a null id is a conversation of its own; rows of
one turn are taken by role, then text, rows without a turn first; a role without an initial fits
nowhere; a conversation without rows has zeros, an empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import parts, settle, small_batches

#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row;
#: the state in which the next role leaves each; the role that leads to a state.
NEXT, ROLES = (2, 2, 3, 2), {2: "user", 3: "assistant"}
FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows still to be put in at the end, by state; what they cost.
CLOSE = ("", "II", "I", "")
END = tuple(INSERT * len(c) for c in CLOSE)
LONG_ROWS, LONG_BYTES, SEGMENT = 4096, 1 << 24, 4096
BLANK, ENDS = re.compile(r"[^\x20\x09-\x0D]"), ".!?"
WHITE = " \t\n\x0b\f\r"
LEGAL = {"su", "ua", "au"}

Distances = list[list[int | None]]


def _edits(kind: str) -> list[tuple[str, int, int, int]]:
    """(initial, from, to, cost) of the edits of a row. A row's kind is the initial of its role, `x` for
    one that fits nowhere, in capitals if truncated, or `d` if it must go."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        out += [("K", q, to, KEEP + more) for (q, initial), to in FITS.items() if initial == kind.lower()]
        out += [("R", q, NEXT[q], REROLE + more) for q in range(4)]
    return out


EDITS = {kind: _edits(kind) for kind in "suaxSUAXd"}
INTO = {kind: [[(q, cost) for _, q, to, cost in edits if to == state] for state in range(4)] for kind, edits in EDITS.items()}
BY_STATE = {kind: [sorted((name, to, cost) for name, q, to, cost in edits if q == state) for state in range(4)] for kind, edits in EDITS.items()}


def distances(kinds: str, goal: tuple[int | None, ...]) -> Distances:
    """Cost from each node to the end, where leaving in state q costs goal[q] (None: not possible).
    Nothing is put in after the last row: that belongs to what follows."""
    n = len(kinds)
    dist: Distances = [[None] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def put(node: tuple[int, int], d: int) -> None:
        while len(buckets) <= d:
            buckets.append([])
        buckets[d].append(node)

    for q, d in enumerate(goal):
        if d is not None:
            put((n, q), d)
    at = 0
    while at < len(buckets):
        for i, q in buckets[at]:  # grows while arcs that cost nothing are followed
            if dist[i][q] is not None:
                continue
            dist[i][q] = at
            if i < n:
                for p in range(4):
                    if NEXT[p] == q and dist[i][p] is None:
                        put((i, p), at + INSERT)
            if i:
                for p, cost in INTO[kinds[i - 1]][q]:
                    if dist[i - 1][p] is None:
                        put((i - 1, p), at + cost)
        at += 1
    return dist


def walk(kinds: str, dist: Distances, entry: int) -> tuple[str, int]:
    """The least audit of a cheapest path from `entry`, and the state in which it leaves."""
    i, q, out = 0, entry, []
    while i < len(kinds):
        d = dist[i][q]
        tight = [(name, i + 1, to) for name, to, cost in BY_STATE[kinds[i]][q] if dist[i + 1][to] is not None and d == dist[i + 1][to] + cost]
        if dist[i][NEXT[q]] is not None and d == dist[i][NEXT[q]] + INSERT:
            tight.append(("I", i, NEXT[q]))
        name, i, q = min(tight)
        out.append(name)
    return "".join(out), q


@lru_cache(maxsize=1 << 14)
def repaired(kinds: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    dist = distances(kinds, END)
    audit, state = walk(kinds, dist, 0)
    return dist[0][0], audit + CLOSE[state]


def edited(audit: str, rows: Iterator[tuple[str, str]], state: int = 0) -> list[str]:
    """`role:text` of what is left of the rows."""
    out = []
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(f"{ROLES[state]}:")
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        state = NEXT[state] if edit == "R" else FITS[state, role[0]]
        out.append(f"{ROLES[state] if edit == 'R' else role}:{text}")
    return out


def _kind(role: str, gone: bool, cut: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "d" if gone else initial.upper() if cut else initial


FIGURES = ("blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(rows: list[tuple[str, str]]) -> tuple:
    seen, kinds, found = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        blank, repeat, cut = not BLANK.search(text), (role, text) in seen, text.rstrip(WHITE)[-1:] not in ENDS
        seen.add((role, text))
        fault = "blank" if blank else "duplicate" if repeat else "truncated" if cut else None
        if fault:
            found[fault] += 1
        kinds.append(_kind(role, blank or repeat, cut))
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = repaired("".join(kinds))
    return *found.values(), illegal, cost, audit, hashlib.sha256("\n".join(edited(audit, iter(rows))).encode()).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * len(FIGURES), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", *FIGURES, "audit", "repaired_sha256"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, role, text) to one row a conversation."""
    key, rows, made = None, [], []
    for batch in batches:
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
            if k != key and rows:
                made.append((key, *_whole(rows)))
                rows = []
            key = k
            rows.append((role, text))
        if made:
            yield _batch(made)
            made = []
    if rows:
        yield _batch([(key, *_whole(rows))])


def _summary(segment: pd.DataFrame) -> pd.DataFrame:
    """A segment's figures, its rows' kinds, its outer initials and its distances between states."""
    segment = segment.sort_values("at")
    kinds, initials, faults = "".join(segment["kind"]), list(segment["initial"]), segment["fault"].value_counts()
    between = []
    for q in range(4):
        dist = distances(kinds, tuple(0 if x == q else None for x in range(4)))
        between.append([-1 if d is None else d for d in dist[0]])
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    row = {"key": segment["key"].iloc[0], "part": segment["part"].iloc[0], "seg": segment["seg"].iloc[0], "kinds": kinds, "first": initials[0], "last": initials[-1], "illegal": illegal, **{f: int(faults.get(f, 0)) for f in FIGURES[:3]}, "between": [between[to][q] for q in range(4) for to in range(4)]}
    return pd.DataFrame([row])


def _cuts(segments: pd.DataFrame) -> pd.DataFrame:
    """The distances to a conversation's end at the end of each of its segments, and its figures."""
    s = segments.sort_values(["part", "seg"]).reset_index(drop=True)
    after, to_end = [], list(END)
    for between in reversed(s["between"].tolist()):
        after.append(to_end)
        to_end = [min(between[4 * q + to] + to_end[to] for to in range(4) if between[4 * q + to] >= 0) for q in range(4)]
    out = s[["key", "part", "seg"]].copy()
    out["after"], out["final"] = after[::-1], [False] * (len(s) - 1) + [True]
    for f in FIGURES[:3]:
        out[f] = s[f].sum()
    out["illegal"] = s["illegal"].sum() + sum(a + b not in LEGAL for a, b in zip(s["last"], s["first"].iloc[1:], strict=False))
    out["cost"] = to_end[0]
    return out


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which each segment ends, by the state in which it begins."""
    for b in batches:
        exits = []
        for kinds, after in zip(b["kinds"], b["after"], strict=True):
            dist = distances(kinds, tuple(int(x) for x in after))
            exits.append([walk(kinds, dist, q)[1] for q in range(4)])
        yield b[["key", "part", "seg"]].assign(exits=exits)


def _entries(segments: pd.DataFrame) -> pd.DataFrame:
    s = segments.sort_values(["part", "seg"])
    entry, state = [], 0
    for exits in s["exits"]:
        entry.append(state)
        state = int(exits[state])
    return s[["key", "part", "seg"]].assign(entry=entry)


def _pieces(rows: pd.DataFrame) -> pd.DataFrame:
    """A segment's part of the audit and of the repaired rows."""
    rows = rows.sort_values("at")
    one = rows.iloc[0]
    kinds, entry = "".join(rows["kind"]), int(one["entry"])
    audit, state = walk(kinds, distances(kinds, tuple(int(x) for x in one["after"])), entry)
    audit += CLOSE[state] if one["final"] else ""
    left = edited(audit, zip(rows["role"], rows["text"], strict=True), entry)
    return pd.DataFrame([{"key": one["key"], "part": one["part"], "seg": one["seg"], **{f: one[f] for f in FIGURES}, "piece": audit, "left": "\n".join(left), "n_left": len(left)}])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row a conversation."""
    key = figures = digest = audit = some = None

    def row() -> pa.RecordBatch:
        return _batch([(key, *figures, "".join(audit), digest.hexdigest())])

    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] != key:
                if key is not None:
                    yield row()
                key, figures, digest, audit, some = r["key"], [r[f] for f in FIGURES], hashlib.sha256(), [], False
            audit.append(r["piece"])
            if r["n_left"]:
                digest.update((f"\n{r['left']}" if some else r["left"]).encode())
                some = True
    if key is not None:
        yield row()


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """Results of conversations that no single task holds."""
    spark, n = rows.sparkSession, parts(rows.sparkSession)
    order = ["key", "turn", "role", "text", "row"]
    at = F.monotonically_increasing_id()
    rows = rows.withColumn("row", at).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = settle(rows.select("key", "role", "text", F.spark_partition_id().alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "turns")
    rows = rows.withColumns({"seg": F.floor(F.col("at") / segment), "content": F.sha2("text", 256)})
    first = rows.groupBy("key", "role", "content").agg(F.min(F.struct("part", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    blank, cut = ~F.col("text").rlike(BLANK.pattern), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    repeat = F.coalesce(F.struct("part", "at") > F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    named = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    kind = F.when(blank | repeat, "d").when(cut, F.upper(named)).otherwise(named)
    fault = F.when(blank, "blank").when(repeat, "duplicate").when(cut, "truncated").otherwise("none")
    judged = rows.join(first, ["key", "role", "content"], "left").select("key", "part", "seg", "at", "role", "text", initial.alias("initial"), kind.alias("kind"), fault.alias("fault"))
    judged = settle(judged, "kinds")
    place = ["key", "part", "seg"]
    segments = judged.select(*place, "at", "kind", "initial", "fault").groupBy(*place).applyInPandas(_summary, "key string, part int, seg long, kinds string, first string, last string, illegal long, blank long, duplicate long, truncated long, between array<long>")
    segments = settle(segments, "segments")
    cuts = settle(segments.drop("kinds").groupBy("key").applyInPandas(_cuts, "key string, part int, seg long, after array<long>, final boolean, blank long, duplicate long, truncated long, illegal long, cost long"), "cuts")
    exits = segments.select(*place, "kinds").join(cuts.select(*place, "after"), place).mapInPandas(_exits, "key string, part int, seg long, exits array<long>")
    entries = exits.groupBy("key").applyInPandas(_entries, "key string, part int, seg long, entry long")
    known = settle(cuts.join(entries, place), "entries")
    pieces = judged.join(known, place).groupBy(*place).applyInPandas(_pieces, "key string, part int, seg long, blank long, duplicate long, truncated long, illegal long, cost long, piece string, left string, n_left long")
    return pieces.repartition(n, "key").sortWithinPartitions(*place).mapInArrow(_joined, RESULT)


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("~"))


def repair(rows: DataFrame, ids: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of `ids`: its id, gaps in its turns, rows by their first fault,
    neighbours that may not follow each other, the least cost, the audit and the digest."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select(_key(F.col(conv)).alias("key"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    per_turn = rows.groupBy("key", "turn").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = settle(per_turn.groupBy("key").agg(gaps.alias("gaps"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "turn-counts")
    long_keys = counts.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("key")
    short, some_long = rows, bool(long_keys.take(1))
    if some_long:
        short = rows.join(long_keys, "key", "left_anti")
    made = short.repartition(parts(spark), "key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text").mapInArrow(_short, RESULT)
    if some_long:
        made = made.unionByName(_long(rows.join(long_keys, "key", "left_semi"), segment))
    every = ids.select(conv).distinct().withColumn("key", _key(F.col(conv)))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FIGURES)}
    out = every.join(counts.select("key", "gaps"), "key", "left").join(made, "key", "left")
    return out.select(conv, *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", modulus: int = 20) -> DataFrame:
    """Rows as damaged by the checksum of `conversation:turn`: of `modulus` classes, 0 drops the row, 1
    empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it and 4 gives
    it to the user. Nulls count as one space."""
    plain = rows.select(conv, turn, *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in (role, text)))
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))
    hit = plain.withColumn("__class", F.crc32(named) % modulus).where("__class != 0")
    texts = F.when(F.col("__class") == 1, "").when(F.col("__class") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    roles = F.when(F.col("__class") == 4, "user").otherwise(F.col(role))
    times = F.explode(F.when(F.col("__class") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select(conv, turn, roles.alias(role), texts.alias(text), times.alias("__time")).drop("__time")
