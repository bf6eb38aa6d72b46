"""SentencePiece BPE encoding by backtracking, and decoding.

The model file is read directly (vocabulary, scores, kinds, normaliser flags). A text is encoded
piecewise: no piece of the vocabulary holds a space mark after another character, so the text can
be cut before each run of space marks and each chunk encoded by itself; chunks repeat, so each
worker keeps a bounded cache of them.

Within a chunk, an Aho-Corasick automaton lists the pieces that begin at each position. From the
left, the longest piece is taken that is compatible with the piece before it, that is, whose
concatenation merges back into just these two pieces; where none fits, the last piece is undone,
the position is marked in a bitfield as failed, and a shorter piece is tried. A sequence whose
neighbours are all compatible is the one that merging pair by pair gives.

Null and empty texts have no ids and decode to the empty text. Texts of any length are handled
whole. Extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.textkit import lists

MARK = "▁"
#: Chunks that a worker remembers; the frequent ones come early, so those after that are not kept.
CACHE_CHUNKS = 600_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: (number, value)."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Vocabulary of a BPE model file with byte fallback and an identity normaliser that puts one
    space mark before the text. A model of another type, or with other flags, is an error."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        import struct

        import ahocorasick

        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        # fixed values: field numbers and defaults of the model file's format
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only merge models with byte fallback and space marks in front are supported")
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only identity normalisers that put a space mark in front, keep all spaces and mark them are supported")
        if self.USER in self.kinds or self.UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == self.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with inner space marks are not supported")
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == self.BYTE}
        self.last_control = max((i for i, k in enumerate(self.kinds) if k == self.CONTROL), default=-1)
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.plain = [b"" if k == self.CONTROL else (" ⁇ ".encode() if k == self.UNKNOWN else (bytes([int(p[3:5], 16)]) if k == self.BYTE else p.replace(MARK, " ").encode())) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._prepare()
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def merged(self, text: str, trace: bool = False) -> list:
        """Merging pair by pair: always the pair whose piece scores highest, the leftmost of equals.
        With `trace`, the merges in their order instead of the pieces."""
        parts, trail = list(text), []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            trail.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return trail if trace else parts

    def _prepare(self) -> None:
        """For each piece of more than one character: its place in the order of merges, and the two
        parts that merge into it last. Pieces for which merges do not come in this order (equal
        scores, parts that score lower) are left to `merged`."""
        self.rank = {p: r for r, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[self.ids[p]]))}
        self.parts: dict[str, tuple[str, str] | None] = {}
        seen = Counter(self.scores[self.ids[p]] for p in self.rank)
        ties = {score for score, n in seen.items() if n > 1}
        for p in self.rank:
            trail = self.merged(p, trace=True)
            ranks = [self.rank[x[0] + x[1]] for x in trail]
            regular = trail and "".join(trail[-1]) == p and ranks == sorted(ranks) and self.scores[self.ids[p]] not in ties
            self.parts[p] = trail[-1] if regular else None

    def fits(self, left: str, right: str) -> bool:
        """Whether the concatenation merges back into just these two pieces. The later of the merges
        that made them is undone again and again; if at any time the two pieces at the boundary
        would have merged with each other first, the pair does not fit."""
        rank, parts = self.rank, self.parts
        a, b, limit = left, right, 1 << 60
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                split, limit = parts[a], ra
                if split is None:
                    break
                a = split[1]
            else:
                split, limit = parts[b], rb + 1
                if split is None:
                    break
                b = split[0]
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > CACHE_CHUNKS:
                self.compatible.clear()
            known = self.compatible[key] = self.merged(left + right) == [left, right]
        return known

    def backtrack(self, chunk: str) -> list[str]:
        """The pieces of one chunk; characters outside the vocabulary stand alone."""
        n = len(chunk)
        begins: list[list[int]] = [[] for _ in range(n)]
        for end, (length, _) in self.automaton.iter(chunk):
            begins[end - length + 1].append(length)
        for lengths in begins:
            if not lengths or lengths[0] != 1:
                lengths.insert(0, 1)
        failed = bytearray((n >> 3) + 1)
        starts: list[int] = []
        tries: list[int] = []
        pos, option = 0, len(begins[0]) - 1
        while pos < n:
            last = chunk[starts[-1] : pos] if starts else None
            placed = False
            while option >= 0:
                end = pos + begins[pos][option]
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.fits(last, chunk[pos:end])):
                    placed = True
                    break
                option -= 1
            if placed:
                starts.append(pos)
                tries.append(option)
                pos = end
                option = len(begins[pos]) - 1 if pos < n else -1
            else:
                if not starts:
                    raise ValueError("no sequence of pieces fits")
                failed[pos >> 3] |= 1 << (pos & 7)
                pos = starts.pop()
                option = tries.pop() - 1
        return [chunk[a:b] for a, b in zip(starts, [*starts[1:], n], strict=True)]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        found = self.cache.get(chunk)
        if found is None:
            stem = self.cache.get(chunk[:-1]) if chunk[-1] in ".,;:!?" else None
            if stem and chunk[-1] in self.ids and self.kinds[stem[-1]] == self.NORMAL and self.fits(self.pieces[stem[-1]], chunk[-1]):
                found = (*stem, self.ids[chunk[-1]])
            else:
                out: list[int] = []
                for p in self.backtrack(chunk):
                    i = self.ids.get(p)
                    if i is not None:
                        out.append(i)
                    elif self.byte_id:
                        out.extend(self.byte_id[x] for x in p.encode())
                    else:
                        out.append(self.unknown)
                found = tuple(out)
            if len(chunk) <= 64 and len(self.cache) < CACHE_CHUNKS:
                self.cache[chunk] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get = self.cache.get
        for chunk in self.cut.findall(MARK + text.replace(" ", MARK)):
            out.extend(get(chunk) or self.chunk_ids(chunk))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Control pieces vanish, one space at the very start goes, runs of byte pieces become
        characters, each byte that fits none becoming U+FFFD."""
        plain, kinds = self.plain, self.kinds
        ids = list(ids)
        if any(i <= self.last_control and kinds[i] == self.CONTROL for i in ids):
            runs: list[list[int]] = [[]]
            for i in ids:
                if kinds[i] == self.CONTROL:
                    runs.append([])
                else:
                    runs[-1].append(i)
            runs = [r for r in runs if r]
        else:
            runs = [ids] if ids else []
        out = []
        for r in runs:
            body = b"".join([plain[i] for i in r])
            if not out and kinds[r[0]] == self.NORMAL and body[:1] == b" ":
                body = body[1:]
            try:
                out.append(body.decode())
            except UnicodeDecodeError:
                out.append("".join(self._lenient(body)))
        return "".join(out)

    @staticmethod
    def _lenient(body: bytes) -> Iterator[str]:
        k = 0
        while k < len(body):
            for n in (1, 2, 3, 4):
                try:
                    yield body[k : k + n].decode()
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                yield "�"
                k += 1


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _clear(df: DataFrame, *names: str) -> None:
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already; choose other output names")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the column `ids` (array<int>) with the ids of `text`. An input column of that name is an
    error, other columns are carried along."""
    _clear(df, ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            out = pa.array([m.encode(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the column `out` with the text of `ids` (null: the empty text)."""
    _clear(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = pa.array([m.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode each text in one pass: the id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas) and decoded_sha256 (of the UTF-8 text), with `keep_ids` also token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        decimal = [str(i) for i in range(len(m.pieces))]
        for b in batches:
            n, a, d, kept = [], [], [], []
            for t in b.column(1):
                ids = m.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                d.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(np.array(ids, dtype=np.int32))
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if keep_ids:
                out.append(lists(np.concatenate(kept) if kept else np.zeros(0, np.int32), np.array(n, dtype=np.int64), pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if keep_ids else [])])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else ""))
