"""Vectorised tokenising and hashing of Arrow string batches, for use inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. As UTF-8 continuation bytes never fall
in that set, words can be found on the bytes of a whole batch at once. A word's 64-bit hash is a
polynomial over its bytes (read off a prefix sum that wraps modulo 2**64) followed by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one go (a longer single text forms a slice of its own).
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that part words when only letters, digits and bytes beyond ASCII count as words.
_NON_LETTER = np.ones(256, dtype=bool)
_NON_LETTER[128:] = False
_NON_LETTER[48:58] = _NON_LETTER[65:91] = _NON_LETTER[97:123] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Words:
    """The words of several texts. `doc` is the index of each word's text, `hash` its 64-bit hash,
    `start` and `end` its byte range in `data`; `first[i]:first[i+1]` are the words of text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = True, letters: bool = False):
        self.bounds = bounds
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~(_NON_LETTER if letters else _SPACE)[data]
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        edges = bounds[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        opens[edges] |= inside[1:-1][edges]
        closes[edges - 1] |= inside[1:-1][edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.count)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            up, down = _power(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
            self._hash = mix((total[self.end] - total[self.start]) * down[self.start])
        return self._hash

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text index of every window of `width` words; a text with fewer words, but at
        least one, has its whole sequence as its only window."""
        h, n = self.hash, len(self.hash)
        out = np.zeros(max(0, n - width + 1), dtype=np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(3) + h[k : n - width + 1 + k]) if len(out) else out
        whole = self.doc[: len(out)] == self.doc[width - 1 :] if len(out) else np.zeros(0, dtype=bool)
        hashes, docs = out[whole], self.doc[: len(out)][whole]
        short = np.flatnonzero((self.count > 0) & (self.count < width))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for k in range(width - 1):
                more = self.count[short] > k
                at = self.first[short[more]] + k
                extra[more] = mix(extra[more] * np.uint64(3) + h[at])
            extra = mix(extra + self.count[short].astype(np.uint64))
            hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
        return hashes, docs


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `limit` bytes: (first row, bytes, bounds).
    Null counts as empty."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    row = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            stop = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield row + at, raw[off[at] : off[stop]], off[at : stop + 1] - off[at]
            at = stop
        row += len(chunk)


def words_of(texts, lower: bool = True, letters: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Words]]:
    """Slices of the column as Words. `lower` folds A-Z; with `letters`, ASCII punctuation parts
    words just as white space does."""
    for row, data, bounds in slices(texts, limit):
        yield row, Words(data, bounds, lower, letters)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 values as the int64 values of the same bits, as Spark has no unsigned type."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and each row's length."""
    bounds = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, type=kind))


def pack(bucket: np.ndarray, kind: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows as one binary value per bucket, (bucket, kind, data): the values of the first column, then
    those of the second, and so on. Rows that are shuffled like this cost the JVM one row a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    data = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array([kind] * len(data), pa.string()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


#: The schema of `pack`.
PACKED = "bucket int, kind string, data binary"


def unpack(kinds: dict[str, type], blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of packed rows, all blobs one after another."""
    types = {c: np.dtype(t) for c, t in kinds.items()}
    width = sum(t.itemsize for t in types.values())
    out: dict[str, list[np.ndarray]] = {c: [] for c in types}
    for raw in blobs:
        n, at = len(raw) // width, 0
        for c, t in types.items():
            out[c].append(np.frombuffer(raw, dtype=t, count=n, offset=at))
            at += n * t.itemsize
    return {c: np.concatenate(x) if x else np.zeros(0, types[c]) for c, x in out.items()}


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by these keys. A run is held whole, so
    callers bound its size beforehand (by salts or tiles)."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [np.asarray(table[k]) for k in keys]
        change = np.zeros(table.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
