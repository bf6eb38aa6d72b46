"""Jaccard self-join on word shingles through an R-tree of count vectors.

Each text is the set of its distinct shingle hashes. Shingles are hashed into groups; a text's
counts per group are a point. Two sets that reach the threshold differ in at most d shingles, so

* the directory of the tree: the groups are cut into more than d blocks per size band, and at
  least one block holds just the same shingles in both. A directory node is the set of texts that
  agree in one block of their band (its box has no extent in that block). Only nodes with two or
  more different sets are kept. A text near the edge of a band also enters the band below, so every
  pair that can link meets in at least one node;
* below a node: an R-tree of the points, packed by size and coordinates. The overlap of a query
  with anything inside a box is at most the sum of the coordinate minima of the query and the
  box's upper corner; subtrees, then points, whose bound is too low are left out;
* pairs that survive are verified on the whole sets.

Equal sets are one point from the start. In a few rounds each text is first compared with one
pivot, of the node of another component that it shares most blocks with, which ties most groups of
copies together; the R-tree search then runs in all nodes that still hold different components,
for all pairs across components, as only those can change the result. Large nodes are searched in tiles of
bounded size, so no task holds an unbounded group; each pair of tiles is a task of its own.

Null, empty and white-space texts have an empty set, link with nothing and are their own class;
texts with fewer words than a shingle have their whole sequence as one shingle. Rows that repeat an
id count as one document with the union of their links: the result has one row for each row. A row
with a null id has the class of its text if a row with an id has the same set, else none (null).
Hashes have 64 bits. Other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import components, drop, parts, settle, tidy
from lodestone.llm.textkit import PACKED, groups, lists, mix, pack, signed, unpack, words_of

#: Rounds in which each text is compared with one pivot of its nodes.
PIVOTS = 4
#: Coordinates of a point, points of a leaf, texts of a tile, edges of one hub verified together.
GROUPS, FANOUT, TILE, HUB = 256, 32, 2048, 4096
#: So many edges (24 bytes each) are broadcast to where the sets are.
FEW_EDGES = 1 << 20
#: Pairs that a task hands on at a time.
PAIRS = 1 << 16
#: Keys of a text, the smallest ones, by which a pair is recognised that an earlier node gives too.
EARLIER = 64


class Threshold:
    """|A & B| / |A | B| >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, sizes):
        """The least overlap of two sets whose sizes add up to this."""
        return -(-(self.num * sizes) // (self.num + self.den))

    def bands(self, largest: int) -> np.ndarray:
        """First sizes of the bands: a pair that links lies in one band or in two neighbours."""
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, (out[-1] - 1) * self.den // self.num + 1))
        return np.array(out)

    def blocks(self, low: int, high: int) -> tuple[int, int]:
        """(blocks, spare) for pairs whose smaller set has between low and high - 1 shingles: more
        blocks than the pair can differ in; as many as `spare` blocks may be empty."""
        most = high - 1
        sizes = most + most * self.den // self.num
        differ = max(s - 2 * int(self.needed(s)) for s in range(max(2 * low, sizes - 2 * (self.num + self.den)), sizes + 1))
        spare = 0 if differ <= 0 else 1 + (differ + 1) // 8
        return (0, 0) if differ <= 0 else (differ + 1 + spare, spare)


def _sets(texts, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of each text, a slice of texts at a time so that a task holds
    no more than a few megabytes of them: (first row, sets)."""
    for row, w in words_of(texts):
        h, doc = w.shingles(width)
        order = np.argsort(doc, kind="stable")
        bounds = np.searchsorted(doc[order], np.arange(len(w.count) + 1))
        h = h[order]
        yield row, [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _digest(s: np.ndarray) -> np.uint64:
    """A hash of the set."""
    if not len(s):
        return np.uint64(0)
    k = np.uint64(len(s))
    return mix(np.array([np.add.reduce(mix(s + np.uint64(0x632BE59BD9B4E019))) ^ mix(np.array([k]))[0]]))[0]


def _keys(s: np.ndarray, rule: Threshold, bands: np.ndarray, cache: dict) -> np.ndarray:
    """The directory nodes of a set: for its band and the one below, a hash of each block's
    content. Empty blocks are named only if there are more of them than the band has spare."""
    n = len(s)
    band = int(np.searchsorted(bands, n, side="right")) - 1
    out = []
    for b in (band, band - 1):
        if b < 0:
            continue
        if b not in cache:
            cache[b] = rule.blocks(int(bands[b]), int(bands[b + 1]))
        m, spare = cache[b]
        if not m:
            continue
        seed = np.uint64((b * 0x9E3779B97F4A7C15) & (2**64 - 1))
        where = ((mix(s ^ seed) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(where, kind="stable")
        at = np.flatnonzero(np.diff(where[order].astype(np.int64), prepend=-1))
        block = where[order][at]
        content = np.add.reduceat(mix(s + np.uint64(0xA0761D6478BD642F))[order], at)
        out.append(mix(mix(content) ^ mix(block + seed)))
        if m - len(block) > spare:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), block)
            out.append(mix(mix(empty + seed) + np.uint64(1)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _points(s: np.ndarray) -> bytes:
    """Counts per group, two bytes each, or four if one needs more."""
    counts = np.bincount((mix(s + np.uint64(7)) >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def _point_table(points: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, dtype=np.uint16 if len(p) == 2 * GROUPS else np.uint32) for p in points]).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))


def named_sets(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """Per row: id, n (size of its set) and node (hash of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, sets in _sets(b.column(1), width):
                node = np.array([_digest(s) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(node))], names=["id", "n", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text).mapInArrow(run, f"id {kind}, n long, node long")


#: Bytes of a task's directory keys that are packed together.
PIECE = 16 << 20
_ENTRY = {"key": np.uint64, "node": np.uint64}


def directory(docs: DataFrame, id_col: str, text: str, width: int, rule: Threshold, p: int) -> DataFrame:
    """(key, node): the directory nodes with two or more different sets, and these. Taken from the texts
    anew rather than kept with `named_sets`, as the keys are as large as the texts; they travel packed
    by bucket, pairs that come twice within a piece only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, cache = rule.bands(1 << 12), {}
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            k, n = np.concatenate(keys), np.concatenate(nodes)
            keys.clear()
            nodes.clear()
            order = np.lexsort([n, k])
            k, n = k[order], n[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
            k, n = k[new], n[new]
            return pack((k % np.uint64(p)).astype(np.int32), "", [k, n])

        for b in batches:
            for _, sets in _sets(b.column(0), width):
                for s in sets:
                    while len(s) >= bands[-1]:
                        bands = rule.bands(int(bands[-1]) * 2)
                    if len(s):
                        keys.append(_keys(s, rule, bands, cache))
                        nodes.append(np.full(len(keys[-1]), _digest(s)))
                        size += 16 * len(keys[-1])
                if size >= PIECE:
                    yield packed()
                    size = 0
        if size:
            yield packed()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column(2).to_pylist()]
        c = unpack(_ENTRY, blobs)
        del blobs
        k = np.sort(c["key"])
        twice = np.unique(k[1:][k[1:] == k[:-1]])
        if not len(twice):
            return
        at = np.minimum(np.searchsorted(twice, c["key"]), len(twice) - 1)
        mine = np.flatnonzero(twice[at] == c["key"])
        k, n = c["key"][mine], c["node"][mine]
        order = np.lexsort([n, k])
        k, n = k[order], n[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
        k, n = k[new], n[new]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        cut = np.flatnonzero(first)
        several = np.repeat(np.diff([*cut, len(k)]) > 1, np.diff([*cut, len(k)]))
        k, n = k[several], n[several]
        for at in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[at : at + (1 << 16)])), pa.array(signed(n[at : at + (1 << 16)]))], names=["key", "node"])

    return _texts(docs, id_col, text).select("text").mapInArrow(run, PACKED).repartitionById(p, "bucket").mapInArrow(shared, "key long, node long")


def _whole_sets(need: DataFrame, docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(node, n, set, point) of the texts in `need` (node, id). Where rows repeat an id, those with
    another set are left out, and equal rows may repeat, which changes no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, sets in _sets(b.column(1), width):
                named = b.column(0).slice(row, len(sets))
                same = signed(np.array([_digest(s) for s in sets], dtype=np.uint64)) == np.asarray(named)
                sets = [s for s, k in zip(sets, same, strict=True) if k]
                flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([named.filter(pa.array(same)), pa.array(n), lists(flat, n, pa.int64()), pa.array([_points(s) for s in sets], pa.binary())], names=["node", "n", "set", "point"])

    texts = _texts(docs, id_col, text).join(need.select("node", "id"), "id").select("node", "text")
    return texts.mapInArrow(run, "node long, n long, set array<long>, point binary")


def verified(edges: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """The edges (a, b) whose sets reach the threshold. Edges are dealt out by their hub b, hubs
    with many edges in several parts; each task streams over its rows and holds one hub's set."""
    spark = edges.sparkSession
    edges = settle(edges.select("a", "b"), "edges")
    hubs = edges.groupBy("b").agg(F.count("*").alias("k")).withColumn("parts", (F.col("k") / HUB).cast("long") + 1)
    spokes = settle(edges.join(hubs, "b").select("b", F.pmod(F.xxhash64("a"), "parts").alias("part"), "a"), "spokes")
    heads = hubs.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # few edges go to the sets, which then need no shuffle of their own; many meet them in one
    near = F.broadcast if spokes.count() <= FEW_EDGES else lambda d: d
    s = sets.select("node", "set")
    spokes = s.withColumnRenamed("node", "a").join(near(spokes), "a").select("b", "part", "a", "set")
    heads = s.withColumnRenamed("node", "b").join(near(heads), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            col = batch.column(3)
            off = np.asarray(col.offsets)
            flat = np.asarray(col.values)
            b, part, a = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                own = flat[off[k] : off[k + 1]].view(np.uint64)
                if a[k] is None:
                    hub, held = (b[k], part[k]), own.copy()
                elif hub == (b[k], part[k]):
                    both = np.concatenate([held, own])
                    both.sort()
                    if int((both[1:] == both[:-1]).sum()) >= rule.needed(len(held) + len(own)):
                        out.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    rows = spokes.unionByName(heads).repartition(parts(spark), "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


class RTree:
    """Points packed into boxes of FANOUT, level upon level. A box keeps the upper corner, the
    smallest size inside, and the label if all points inside share it (else -1)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        order = np.lexsort((points.argmax(axis=1), sizes))
        self.order, self.points, self.sizes, self.labels = order, points[order], sizes[order], labels[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        p, s, l = self.points, self.sizes, self.labels
        while len(s) > 1:
            cut = np.arange(0, len(s), FANOUT)
            low, high = np.minimum.reduceat(l, cut), np.maximum.reduceat(l, cut)
            p, s, l = np.maximum.reduceat(p, cut, axis=0), np.minimum.reduceat(s, cut), np.where(low == high, low, -1)
            self.levels.append((p, s, l))

    def search(self, q: np.ndarray, size: int, label: int, rule: Threshold) -> np.ndarray:
        """Places (in `order`) of points of other labels whose bound reaches the needed overlap."""
        at = np.arange(len(self.levels[-1][1])) if self.levels else np.arange(len(self.sizes))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s, l = self.levels[depth]
            at = at[(l[at] != label) | (l[at] < 0)]
            at = at[np.minimum(p[at], q).sum(axis=1) >= rule.needed(s[at] + size)]
            below = len(self.levels[depth - 1][1]) if depth else len(self.sizes)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < below]
        at = at[self.labels[at] != label]
        bound = np.minimum(self.points[at], q).sum(axis=1)
        return at[bound >= rule.needed(self.sizes[at] + size)]


def _smaller(lists_of_keys: pa.ChunkedArray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sorted list the keys below `key`, filled up with `key`, and how many they are."""
    lists_of_keys = pa.concat_arrays(lists_of_keys.chunks)
    flat, length = np.asarray(lists_of_keys.flatten()), np.asarray(lists_of_keys.value_lengths())
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    below = flat < key
    out = np.full((len(length), max(1, EARLIER)), key, dtype=np.int64)
    out[row[below], at[below]] = flat[below]
    return out, np.bincount(row[below], minlength=len(length))


def _search_nodes(rows: DataFrame, rule: Threshold) -> DataFrame:
    """Pairs (a, b) across components that survive the bound, from rows (key, tile_a, tile_b, side,
    node, comp, n, point, keys). Near copies meet in most of their nodes; a pair is left out where
    its texts have a smaller key in common, so the node with its smallest common key gives it. As
    `keys` has only the first few of each text, a pair may still come twice, but is never lost."""

    def of(pairs: list[np.ndarray]) -> pa.RecordBatch:
        out = np.concatenate(pairs, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["key", "tile_a", "tile_b"]):
            node, comp, n = (np.asarray(g[c]) for c in ("node", "comp", "n"))
            side = np.asarray(g["side"])
            points = _point_table(g["point"].to_pylist())
            _, label = np.unique(comp, return_inverse=True)
            right, left = (side == 1, side == 0) if g["tile_a"][0] != g["tile_b"][0] else (side == 0, side == 0)
            if not right.any() or not left.any():
                continue
            tree = RTree(points[right], n[right], label[right])
            names = node[right][tree.order]
            keys, before = _smaller(g["keys"], int(g["key"][0].as_py()))
            theirs = keys[right][tree.order]
            within = bool((side == 0).all())
            pairs: list[np.ndarray] = []
            size = 0
            for k in np.flatnonzero(left):
                found = tree.search(points[k], int(n[k]), int(label[k]), rule)
                if within:  # each pair of a tile is met from both sides
                    found = found[names[found] < node[k]]
                if before[k] and len(found):
                    own = keys[k, : before[k]]
                    spot = np.minimum(np.searchsorted(own, theirs[found]), before[k] - 1)
                    found = found[~(own[spot] == theirs[found]).any(axis=1)]
                hits = names[found]
                if len(hits):
                    pairs.append(np.stack([np.maximum(hits, node[k]), np.minimum(hits, node[k])]))
                    size += len(hits)
                if size >= PAIRS:
                    yield of(pairs)
                    pairs, size = [], 0
            if pairs:
                yield of(pairs)

    return rows.repartition(parts(rows.sparkSession), "key", "tile_a", "tile_b").sortWithinPartitions("key", "tile_a", "tile_b").mapInArrow(run, "a long, b long").distinct()


def link_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of `docs`: the id, n_shingles, component_id (the smallest id that can be
    reached by links between texts whose Jaccard similarity is num / den or more)."""
    spark = docs.sparkSession
    rule = Threshold(num, den)
    p = parts(spark)
    members = settle(named_sets(docs, id_col, text, width), "sets")
    first = members.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"))

    nodes = settle(directory(docs.where(F.col(id_col).isNotNull()), id_col, text, width, rule, p), "nodes")
    tidy(spark)

    need = nodes.select("node").distinct().join(first, "node")
    sets = settle(_whole_sets(need, docs, id_col, text, width), "whole")
    tidy(spark)
    links, comp = None, nodes.select("node").distinct().withColumn("comp", F.col("node"))
    for turn in range(PIVOTS):
        placed = nodes.join(comp, "node")
        pivot = placed.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))).alias("pivot"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key", "pivot")
        tries = placed.join(pivot, "key").where(F.col("comp") != F.col("pivot.comp")).groupBy("node", F.col("pivot.node").alias("b")).agg(F.count("*").alias("k"))
        tries = tries.groupBy("node").agg(F.max_by("b", F.struct("k", "b")).alias("b")).select(F.col("node").alias("a"), "b")
        found = settle(verified(tries, sets, rule), "links")
        links = found if links is None else links.unionByName(found)
        whole = components(links)
        comp = settle(comp.select("node").join(whole, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "comp")
        tidy(spark)

    placed = nodes.join(comp, "node")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.bit_xor(F.hash("node")).alias("also")).where("c0 < c1")
    mixed = mixed.groupBy("k", "who", "also").agg(F.min("key").alias("key")).select("key", F.expr(f"cast(ceil(k / {TILE}) as int)").alias("tiles"))
    searched = settle(placed.join(mixed, "key"), "searched")
    own = searched.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, EARLIER).alias("keys"))
    held = settle(searched.join(sets.select("node", "n", "point").join(own, "node"), "node"), "held")
    tile = F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile")
    spread = held.select("key", "node", "comp", "n", "point", "keys", "tiles", tile).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    spread = spread.select("key", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "comp", "n", "point", "keys")
    pairs = settle(_search_nodes(spread, rule), "pairs")
    tidy(spark)
    more = settle(verified(pairs, sets, rule), "links")
    tidy(spark)
    final = settle(components(links.unionByName(more)), "comp")
    drop(nodes, sets, searched, held, pairs)

    by_node = first.join(final, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
    smallest = by_node.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = by_node.join(smallest, "comp").select("node", "component_id")
    filled = members.where("n > 0").join(named, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return filled.unionByName(empty)
