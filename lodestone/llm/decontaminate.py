"""Benchmark decontamination with spaced seeds.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. A document leaks a
benchmark item if SPAN words of it, in a row, equal SPAN words in a row of the item in at least
SPAN - TOLERANCE places (no gaps). The span is cut into four blocks; each mask looks at two of them
and ignores the other positions, so whatever TOLERANCE substitutions a window has, some mask sees
none of them. The hash of the positions a mask looks at is the seed.

The seeds of the benchmark, however many, are summed up in a bit field of fixed size that each task
gets; only document windows whose bit is set leave the map side. These are joined with the
benchmark's seeds by Spark, and each pair of windows is compared word by word.

Items with fewer than SPAN words leak by their whole sequence without substitutions, however short
they are; `whole_item` tells such pairs apart, and a caller who finds them too common can leave them
out. Items without words never leak. Null and empty texts leak nothing. Rows that repeat an id count as one document, items likewise. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import settle
from lodestone.llm.textkit import Words, mix, signed, words_of

SPAN, TOLERANCE = 12, 2
BLOCK = SPAN // 4
MASKS = tuple(combinations(range(4), 2))
#: Bits of the field: fixed, 8 MB.
BITS = 26


def _seeds(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: the words at which a whole span begins, and the seeds there."""
    n = len(w.doc) - SPAN + 1
    if n <= 0:
        return
    at = np.flatnonzero(w.doc[:n] == w.doc[SPAN - 1 :])
    h = w.hash
    block = np.zeros(len(h) - BLOCK + 1, dtype=np.uint64)
    for k in range(BLOCK):
        block = block * np.uint64(0x100000001B3) + h[k : len(h) - BLOCK + 1 + k]
    block = mix(block)
    for k, (a, b) in enumerate(MASKS):
        yield at, mix(block[at + a * BLOCK] * np.uint64(3) + block[at + b * BLOCK] * np.uint64(5) + np.uint64(k))


def _grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of n words begin, and their hashes."""
    m = len(w.doc) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    out = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + w.hash[at + k])
    return at, out


def _rows(ids: pa.Array, base: int, w: Words, at: np.ndarray, seed: np.ndarray, length: int) -> pa.RecordBatch:
    window = np.zeros((len(at), SPAN), dtype=np.uint64)
    for k in range(length):
        window[:, k] = w.hash[at + k]
    packed = window.tobytes()
    words = pa.array([packed[i : i + 8 * SPAN] for i in range(0, len(packed), 8 * SPAN)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(signed(seed)), ids.take(pa.array(base + w.doc[at])), pa.array((at - w.first[w.doc[at]]).astype(np.int64)), words], names=["seed", "id", "pos", "words"])


def _schema(df: DataFrame, id_col: str) -> str:
    return f"seed long, id {df.schema[id_col].dataType.simpleString()}, pos long, words binary"


def benchmark_seeds(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """(seed, id, pos, words) of every window of every item, and of short items as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, w in words_of(b.column(1), letters=True):
                for at, seed in _seeds(w):
                    yield _rows(b.column(0), base, w, at, seed, SPAN)
                for n in range(1, SPAN):
                    at, seed = _grams(w, n)
                    whole = w.count[w.doc[at]] == n
                    yield _rows(b.column(0), base, w, at[whole], seed[whole], n)

    return items.select(id_col, text).mapInArrow(run, _schema(items, id_col))


def bit_field(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed's low bits: 2**BITS bits at most, gathered as words of 64."""
    low = F.col("seed").bitwiseAND((1 << BITS) - 1)
    words = seeds.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    field = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    got = words.toPandas()
    field[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return field


def document_seeds(docs: DataFrame, field: np.ndarray, short: list[int], id_col: str, text: str) -> DataFrame:
    """The documents' windows whose bit is set; `short` has the lengths of items below SPAN words. Of
    equal short windows of a document only the first is given."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.uint64((1 << BITS) - 1)

        def set_(seed: np.ndarray) -> np.ndarray:
            low = seed & mask
            return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1

        for b in batches:
            for base, w in words_of(b.column(1), letters=True):
                for at, seed in _seeds(w):
                    hit = set_(seed)
                    if hit.any():
                        yield _rows(b.column(0), base, w, at[hit], seed[hit], SPAN)
                for n in short:
                    at, seed = _grams(w, n)
                    hit = np.flatnonzero(set_(seed))
                    if len(hit):
                        _, first = np.unique(mix(seed[hit] ^ mix(w.doc[at[hit]].astype(np.uint64))), return_index=True)
                        hit = hit[np.sort(first)]
                        yield _rows(b.column(0), base, w, at[hit], seed[hit], n)

    return docs.select(id_col, text).mapInArrow(run, _schema(docs, id_col))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """One row for each pair of a document and an item it leaks: id_col, item_col, n_windows (item
    windows found), best_match (most equal words of a window), first_word (place of the first such
    window in the document, counted in words), whole_item (the item is shorter than SPAN words)."""
    seeds = settle(benchmark_seeds(items, item_col, item_text), "seeds")
    length = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda k: F.substring(F.hex("words"), k * 16 + 1, F.lit(16))), lambda x: x != "0" * 16))
    short = sorted(r[0] for r in seeds.select(length.alias("n")).distinct().where(F.col("n") < SPAN).collect())  # SPAN - 1 rows at most
    found = document_seeds(docs, bit_field(seeds), short, id_col, text)
    seeds = seeds.select("seed", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("words").alias("item_words"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint64).reshape(-1, SPAN) for k in (4, 5))
            short = (y == 0).any(axis=1)
            same = ((x == y) & (y != 0)).sum(axis=1)
            ok = np.where(short, (x == y).all(axis=1), same >= SPAN - TOLERANCE)
            kept = pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(same.astype(np.int64)), pa.array(short)], names=[id_col, item_col, "pos", "item_pos", "same", "whole"])
            yield kept.filter(pa.array(ok))

    pairs = found.join(seeds, "seed").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "pos", "item_pos", "words", "item_words")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    equal = pairs.mapInArrow(compare, f"`{id_col}` {kinds[id_col]}, `{item_col}` {kinds[item_col]}, pos long, item_pos long, same long, whole boolean")
    return equal.groupBy(id_col, item_col).agg(F.count_distinct("item_pos").alias("n_windows"), F.max("same").alias("best_match"), F.min("pos").alias("first_word"), F.bool_or("whole").alias("whole_item"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **names) -> DataFrame:
    """The documents that leak no item."""
    return docs.join(leaks(docs, items, id_col, item_col, **names).select(id_col).distinct(), id_col, "left_anti").select(docs.columns)
