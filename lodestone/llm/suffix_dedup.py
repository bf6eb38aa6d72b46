"""Exact substring dedup with suffix arrays.

A byte of a document is removed if a string of LENGTH bytes that covers it also starts in a document
with a smaller id. Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

Suffixes are dealt to tasks by anchors. Of the K-byte strings inside a window of LENGTH bytes, the
one with the smallest hash is the window's anchor; neighbouring windows with the same anchor form a
run. Equal windows have the same anchor at the same place, so only runs with the same anchor need to
be compared.

1. Each task finds the runs of its texts. A run that equals one of a smaller id in the same piece of
   the task is removed there and does not travel, so a passage that very many documents share sends
   one row per piece. The others go to the task of their anchor, packed as byte columns.
2. There, anchors of a single document are left out. A run that equals one of a smaller id is removed
   whole. What is left are anchors around which different runs occur, at the ends of repeated passages.
3. The bytes of each such run are cut out of its text and go to the task of their anchor, which builds
   a suffix array over all its runs by two-stage sorting: only the suffixes that are smaller than
   their successors are sorted directly (as far as LENGTH bytes decide), the others are induced by
   scanning the buckets of first bytes in order. Neighbours with a common prefix of LENGTH bytes or
   more form a class; windows of documents other than the class's smallest id are removed.

The runs of an anchor with more than PART_RUNS of them are dealt to several tasks: each of their
windows goes to the part that its hash names, so that equal windows meet, and each part is sorted in
the same way. Null and empty texts, texts shorter than LENGTH and rows with a null id lose nothing;
texts of rows with a null id count for no one else either. Rows that repeat an id count as one
document, and each row is cleaned by itself. Hashes have 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import parts, settle, tidy
from lodestone.llm.textkit import PACKED, _power, mix, pack, signed, slices, unpack

LENGTH, K = 50, 24
#: Runs of one anchor that one task compares before they are dealt to parts; bytes of one suffix array.
PART_RUNS, ARRAY_BYTES = 20_000, 1 << 20
#: Bytes of text whose runs are packed together.
PIECE_BYTES = 8 << 20


def _windows_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every w values in a row."""
    m, have = x, 1
    while 2 * have <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - have : w - have + len(x) - w + 1])


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each position on."""
    n = len(data) - K + 1
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(n, dtype=np.uint64)
    for k in range(0, K, 8):
        word = np.ndarray((n,), dtype="<u8", buffer=raw, offset=k, strides=(1,))
        out = (out ^ word) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, text) of the runs of all texts."""
    none = np.zeros(0, np.int64)
    w = LENGTH - K + 1
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    x = _grams(data)
    least = _windows_min(x, w)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(size - LENGTH + 1, 0))])
    at = np.arange(len(doc)) - first[doc] + bounds[:-1][doc]
    if not len(at):
        return none.astype(np.uint64), none, none, none
    value = least[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
    cut = np.flatnonzero(new)
    a, b, d = at[cut], at[np.concatenate([cut[1:], [len(at)]]) - 1], doc[cut]
    out = []
    while len(a):
        where = np.empty(len(a), dtype=np.int64)
        for k in range(0, len(a), 1 << 15):
            part = a[k : k + (1 << 15)]
            where[k : k + (1 << 15)] = part + np.argmin(x[part[:, None] + np.arange(w)], axis=1)
        stop = np.minimum(b, where)
        out.append((x[where], a, stop, d))
        more = stop < b
        a, b, d = stop[more] + 1, b[more], d[more]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix(mix((total[end] - total[start]) * down[start]) + (end - start).astype(np.uint64))


def two_stage(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of int symbols `text` in which the places `ends` hold the lowest symbol, -1,
    and end the strings; suffixes are in order as far as LENGTH symbols (up to their end) tell."""
    n = len(text)
    later = np.empty(n, dtype=np.int8)
    later[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    later[-1] = 1
    known = np.flatnonzero(later)
    smaller = later[known][np.searchsorted(known, np.arange(n))] > 0
    smaller[ends] = False
    direct = np.flatnonzero(smaller)
    raw = np.concatenate([np.where(text < 0, 0, text).astype(np.uint8), np.zeros(64, np.uint8)])
    left = ends[np.searchsorted(ends, direct)] - direct
    keys = []
    for k in range(0, LENGTH, 8):
        word = np.ndarray((n,), dtype=">u8", buffer=raw, offset=k, strides=(1,))[direct].astype(np.uint64)
        valid = np.clip(left - k, 0, 8)
        shift = ((8 - valid) * 8).astype(np.uint64)
        keys.append(np.where(valid == 0, np.uint64(0), (word >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63))))
    direct = direct[np.lexsort([np.minimum(left, LENGTH), *keys[::-1]])]
    by_byte = text[direct]
    begins = np.searchsorted(by_byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = [ends]

    def induce(bucket: np.ndarray, symbol: int) -> np.ndarray:
        """Hand on the predecessors that are larger than their successors; return those that fall
        into this same bucket."""
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] >= 0)]
        if not len(before):
            return before
        s = text[before]
        order = np.argsort(s, kind="stable")
        before, s = before[order], s[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        own = before[:0]
        for a, b in zip(cut, [*cut[1:], len(s)], strict=True):
            if s[a] == symbol:
                own = before[a:b]
            else:
                waiting[s[a]].append(before[a:b])
        return own

    induce(ends, -1)
    for symbol in range(256):
        now = np.concatenate(waiting[symbol]) if waiting[symbol] else direct[:0]
        while len(now):
            out.append(now)
            now = induce(now, symbol)
        sorted_here = direct[begins[symbol] : begins[symbol + 1]]
        if len(sorted_here):
            out.append(sorted_here)
            induce(sorted_here, symbol)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of `order` (suffixes with LENGTH symbols or more) the length, up to LENGTH, of
    the prefix that it shares with the one before it."""
    raw = np.concatenate([np.where(text < 0, 0, text).astype(np.uint8), np.zeros(64, np.uint8)])
    out = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(1, len(order))
    for k in range(0, LENGTH, 8):
        if not len(open_):
            break
        word = np.ndarray((len(text),), dtype="<u8", buffer=raw, offset=k, strides=(1,))
        differ = word[order[open_]] ^ word[order[open_ - 1]]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        out[open_] += same
        open_ = open_[same == 8]
    return np.minimum(out, LENGTH)


def repeated_windows(contexts: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each byte string the places of its windows that also occur in one with a smaller id."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    text = np.full(int(ends[-1]) + 1, -1, dtype=np.int16)
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    order = two_stage(text, ends)
    owner = np.searchsorted(ends, order)
    full = ends[owner] - order >= LENGTH
    order, owner = order[full], owner[full]
    cut = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    least = np.minimum.reduceat(ids[owner], cut) if len(order) else ids[:0]
    hit = np.repeat(least, np.diff([*cut, len(order)])) < ids[owner] if len(order) else np.zeros(0, bool)
    places, owners = order[hit], owner[hit]
    by = np.lexsort([places, owners])
    places, owners = places[by], owners[by]
    bounds = np.searchsorted(owners, np.arange(len(contexts) + 1))
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [places[bounds[k] : bounds[k + 1]] - begins[k] for k in range(len(contexts))]


def _spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window places as (start, end) of the bytes they cover, runs of neighbours as one."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    return at[cut], at[np.concatenate([cut[1:], [len(at)]]) - 1] + LENGTH


#: Packed columns: where a span of a row is, and what a run or a need has besides.
SPAN = {"id": np.int64, "content": np.int32, "start": np.int32, "end": np.int32}
RUN = {"h": np.uint64, "run": np.uint64, "id": np.int64, "content": np.int32, "start": np.int32, "size": np.uint8}
NEED = {"h": np.uint64, "k": np.int32, **SPAN}
_KINDS = {"span": SPAN, "run": RUN, "need": NEED}


def _pack(bucket: np.ndarray, kind: str, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pack(bucket, kind, [cols[c].astype(t, copy=False) for c, t in _KINDS[kind].items()])


def _home(ids: np.ndarray, content: np.ndarray, p: int) -> np.ndarray:
    """The bucket of a row's text."""
    return ((ids ^ content.astype(np.int64)) % p).astype(np.int32)


def _merged(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of the same row that touch or overlap as one."""
    if not len(c["id"]):
        return c
    order = np.lexsort([c["start"], c["content"], c["id"]])
    i, t, s, e = (c[k][order] for k in SPAN)
    row = np.cumsum(np.concatenate([[0], ((i[1:] != i[:-1]) | (t[1:] != t[:-1])).astype(np.int64)]))
    reach = np.maximum.accumulate(row * (1 << 33) + e) - row * (1 << 33)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] > reach[:-1])]))
    return {"id": i[new], "content": t[new], "start": s[new], "end": reach[np.concatenate([new[1:] - 1, [len(i) - 1]])].astype(np.int32)}


def _taken(c: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in c.items()}


def _spans_of(c: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """The spans of some runs."""
    start = c["start"][at]
    return {"id": c["id"][at], "content": c["content"][at], "start": start, "end": start + c["size"][at].astype(np.int32)}


def _local(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Runs that travel, and spans of those that equal a run of a smaller id among these."""
    order = np.lexsort([c["id"], c["run"], c["h"]])
    h, run, ids = c["h"][order], c["run"][order], c["id"][order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (run[1:] != run[:-1])])
    first = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
    gone = ids > first
    return _taken(c, np.sort(order[~gone])), _merged(_spans_of(c, order[gone]))


def _found_runs(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            c = {k: np.concatenate([x[k] for x in held]) for k in RUN}
            held.clear()
            if len(c["h"]):
                c, spans = _local(c)
                yield _pack((c["h"] % np.uint64(p)).astype(np.int32), "run", c)
                if len(spans["id"]):
                    yield _pack(_home(spans["id"], spans["content"], p), "span", spans)

        for b in batches:
            ids, content = np.asarray(b.column(0)), np.asarray(b.column(2))
            for row, data, bounds in slices(b.column(1)):
                h, first, last, doc = runs(data, bounds)
                held.append({"h": h, "run": _hashes(data, first, last + LENGTH), "id": ids[row + doc], "content": content[row + doc], "start": (first - bounds[doc]).astype(np.int32), "size": (last + LENGTH - first).astype(np.uint8)})
                size += len(data)
                if size >= PIECE_BYTES:
                    yield from packed()
                    size = 0
        if held:
            yield from packed()

    return run


def _compared_runs(p: int):
    """From the packed runs of a bucket of anchors: spans of runs that equal one of a smaller id, and
    the runs whose anchor has different ones, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for b in batches:
            mine = np.asarray(b.column(1).to_pylist()) == "run"
            blobs += [x for x, m in zip(b.column(2).to_pylist(), mine, strict=True) if m]
            if not mine.all():
                yield b.filter(pa.array(~mine))
        c = unpack(RUN, blobs)
        del blobs
        if not len(c["h"]):
            return
        h = np.sort(c["h"])
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        if not len(twice):
            return
        at = np.minimum(np.searchsorted(twice, c["h"]), len(twice) - 1)
        c = _taken(c, np.flatnonzero(twice[at] == c["h"]))
        c = _taken(c, np.lexsort([c["id"], c["run"], c["h"]]))
        anchor = np.concatenate([[True], c["h"][1:] != c["h"][:-1]])
        kind = anchor | np.concatenate([[True], c["run"][1:] != c["run"][:-1]])
        first = c["id"][np.maximum.accumulate(np.where(kind, np.arange(len(kind)), 0))]
        gone = c["id"] > first
        spans = _merged(_spans_of(c, np.flatnonzero(gone)))
        if len(spans["id"]):
            yield _pack(_home(spans["id"], spans["content"], p), "span", spans)
        cut = np.flatnonzero(anchor)
        number = np.cumsum(anchor) - 1
        kinds = np.add.reduceat(kind.astype(np.int64), cut)
        low, high = np.minimum.reduceat(first, cut), np.maximum.reduceat(first, cut)
        open_ = np.flatnonzero(~gone & ((kinds > 1) & (low < high))[number])
        need = {"h": c["h"][open_], "k": kinds[number[open_]], **_spans_of(c, open_)}
        if len(need["id"]):
            yield _pack(_home(need["id"], need["content"], p), "need", need)

    return run


def _text_rows(docs: DataFrame, id_col: str, text: str, p: int) -> DataFrame:
    """(own, id, content, text, bucket) of every row; `content` is a hash of the text and tells rows
    with the same id apart."""
    d = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), F.hash(text).alias("content"), F.col(text).alias("text"))
    return d.withColumn("bucket", F.pmod(F.coalesce("id", F.lit(0).cast("long")).bitwiseXOR(F.col("content").cast("long")), F.lit(p)).cast("int"))


def _beside(texts: DataFrame, packed: DataFrame, p: int) -> DataFrame:
    """The rows of both by bucket, a bucket's packed rows before its texts."""
    both = packed.unionByName(texts.withColumn("kind", F.lit("text")), allowMissingColumns=True)
    return both.repartitionById(p, "bucket").sortWithinPartitions("kind").select("kind", "data", "own", "id", "content", "text")


class _Held:
    """Packed rows of a bucket by the row they belong to."""

    def __init__(self, kind: str, blobs: list[bytes]):
        c = unpack(_KINDS[kind], blobs)
        order = np.lexsort([c["start"], c["content"], c["id"]])
        self.c = _taken(c, order)
        i, t = self.c["id"], self.c["content"]
        cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])) if len(i) else np.zeros(0, np.int64)
        self.at = {(x, y): (a, b) for x, y, a, b in zip(i[cut].tolist(), t[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(i)], strict=False)}

    def of(self, id_: int | None, content: int) -> tuple[int, int]:
        return self.at.get((id_, content), (0, 0))


def _split(b: pa.RecordBatch) -> tuple[list[bytes], pa.RecordBatch]:
    """The packed data of a batch, and its text rows."""
    texts = np.asarray(b.column(0).to_pylist()) == "text" if b.num_rows else np.zeros(0, bool)
    return b.column(1).filter(pa.array(~texts)).to_pylist(), b.filter(pa.array(texts))


_CONTEXT = "g long, id long, content int, start int, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of needed runs, by anchor; those of an anchor with many runs window by window."""
    blobs: list[bytes] = []
    held: _Held | None = None
    for b in batches:
        packed, rows = _split(b)
        blobs += packed
        if not rows.num_rows:
            continue
        if held is None:
            held, blobs = _Held("need", blobs), []
        g: list[np.ndarray] = []
        at: list[np.ndarray] = []
        who: list[tuple[int, int, int]] = []
        raw: list[bytes] = []
        for id_, content, t in zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), rows.column(5), strict=True):
            x, y = held.of(id_, content)
            if x == y:
                continue
            whole = t.as_buffer().to_pybytes()
            h, k, start, end = (held.c[c][x:y] for c in ("h", "k", "start", "end"))
            many = k > PART_RUNS
            few = np.flatnonzero(~many)
            raw += [whole[s:e] for s, e in zip(start[few].tolist(), end[few].tolist(), strict=True)]
            g.append(h[few])
            at.append(start[few])
            who.append((id_, content, len(few)))
            for j in np.flatnonzero(many).tolist():
                w = np.arange(start[j], end[j] - LENGTH + 1)
                part = _hashes(np.frombuffer(whole, dtype=np.uint8), w, w + LENGTH) % np.uint64(1 + k[j] * 32 // PART_RUNS)
                raw += [whole[s : s + LENGTH] for s in w.tolist()]
                g.append(mix(part ^ h[j]))
                at.append(w)
                who.append((id_, content, len(w)))
        if raw:
            n = [x for _, _, x in who]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(g))), pa.array(np.repeat(np.array([x for x, _, _ in who], dtype=np.int64), n)), pa.array(np.repeat(np.array([x for _, x, _ in who], dtype=np.int32), n)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(raw, pa.binary())], names=["g", "id", "content", "start", "bytes"])


def _sorted_contexts(p: int):
    """Spans of windows that also occur with a smaller id, from contexts sorted by g."""

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        ids, content, start = (np.asarray(t[c]) for c in ("id", "content", "start"))
        hits = repeated_windows(t["bytes"].to_pylist(), ids)
        spans = [_spans(at) for at in hits]
        n = [len(a) for a, _ in spans]
        if not sum(n):
            return None
        who = np.repeat(np.arange(len(ids)), n)
        begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
        c = _merged({"id": ids[who], "content": content[who], "start": (start[who] + begin).astype(np.int32), "end": (start[who] + end).astype(np.int32)})
        return _pack(_home(c["id"], c["content"], p), "span", c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            g = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            # whole groups go into an array until it has ARRAY_BYTES
            total = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(b.column(4))))])
            begin = 0
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                fresh = g[x] != last
                if fresh and size >= ARRAY_BYTES:
                    if x > begin:
                        held.append(b.slice(begin, x - begin))
                    if (out := done(held)) is not None:
                        yield out
                    held, size, begin = [], 0, x
                size += int(total[y] - total[x])
                last = g[x]
            held.append(b.slice(begin))
        if held and (out := done(held)) is not None:
            yield out

    return run


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, kind, data): packed spans of byte ranges to remove, which may overlap."""
    p = parts(docs.sparkSession)
    texts = _text_rows(docs, id_col, text, p).where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH))
    found = texts.select("id", "text", "content").mapInArrow(_found_runs(p), PACKED).repartitionById(p, "bucket")
    marks = settle(found.mapInArrow(_compared_runs(p), PACKED), "marks")
    del found
    tidy(docs.sparkSession)
    contexts = _beside(texts, marks.where("kind = 'need'"), p).mapInArrow(_cut_out, _CONTEXT)
    sorted_ = contexts.repartition(p, "g").sortWithinPartitions("g").mapInArrow(_sorted_contexts(p), PACKED)
    more = settle(sorted_, "spans")
    del contexts, sorted_
    tidy(docs.sparkSession)
    return marks.where("kind = 'span'").unionByName(more)


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256; with `keep_text` also the remaining bytes as `kept` (binary: a cut may fall inside
    a character)."""
    p = parts(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        held: _Held | None = None
        for b in batches:
            packed, rows = _split(b)
            blobs += packed
            if not rows.num_rows:
                continue
            if held is None:
                held, blobs = _Held("span", blobs), []
            size, gone, count, digest, kept = [], [], [], [], []
            for id_, content, t in zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), rows.column(5).to_pylist(), strict=True):
                raw = (t or "").encode()
                pieces, at, n, stop = [], 0, 0, -1
                x, y = held.of(id_, content)
                for s, e in zip(held.c["start"][x:y].tolist(), held.c["end"][x:y].tolist(), strict=True):
                    if s > stop:
                        n += 1
                        pieces.append(raw[at:s])
                    at = stop = max(stop, e)
                pieces.append(raw[at:])
                rest = b"".join(pieces)
                size.append(len(raw))
                gone.append(len(raw) - len(rest))
                count.append(n)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_text else b"")
            out = [rows.column(2), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.binary())] if keep_text else [])], names=names)

    both = _beside(_text_rows(docs, id_col, text, p), removals(docs, id_col, text), p)
    return both.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
