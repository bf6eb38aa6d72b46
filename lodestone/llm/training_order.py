"""Token-id output in training order.

Texts are tokenised and followed by an end token; the tokens of all texts, in the order of the ids and,
where these are equal or null, of a hash of the text, form one stream that is cut into sequences of
fixed length (the last one is filled up with end tokens). A keyed Feistel network over the smallest even number
of bits that holds all sequence numbers, walked along its cycles until the value is in range, is a
permutation: it gives every sequence its slot in training order without a sort or a table. Slots are
dealt out in ranges, one for each shard, and each range is written as one file of fixed stride: slot s
starts at byte (s - first slot) * stride of its shard, so readers can seek, read on sequentially and
resume from a slot number.

Stream, slots and bytes depend on the rows and parameters alone, not on files, cores or partitions.
Their digest is the identity of a run. Beside each shard, and after it, a small JSON file is written
with that identity and the shard's digest. A later run with the same identity leaves out the shards
that have one; a run with another identity (other rows, key, length) writes all shards anew.

Null and empty texts give one end token. Rows that repeat an id stay rows of their own; equal rows are
interchangeable. Token ids take two bytes each, little-endian; a vocabulary that needs more is an
error. Other columns are ignored. An empty table has no sequences and no shards.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import drop, parts, settle, tidy
from lodestone.llm.textkit import mix

LENGTH, SLOTS_PER_SHARD, ROUNDS = 2048, 4096, 6
#: The shards are written in so many runs over the token table, which bounds the shuffle's disk.
WAVES = 2


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def _once(self, x: np.ndarray) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for k in self.keys:
            left, right = right, left ^ (mix(right + k) & low)
        return left << h | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self._once(x.astype(np.uint64))
        while (far := out >= self.n).any():
            out[far] = self._once(out[far])
        return out.astype(np.int64)

    def _back(self, x: np.ndarray) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for k in self.keys[::-1]:
            left, right = right ^ (mix(left + k) & low), left
        return left << h | right

    def inverse(self, x: np.ndarray) -> np.ndarray:
        """The numbers whose places are `x`."""
        out = self._back(x.astype(np.uint64))
        while (far := out >= self.n).any():
            out[far] = self._back(out[far])
        return out.astype(np.int64)


_encodings: dict[str, object] = {}


def _encoding(path: str, pattern: str):
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def tokens(docs: DataFrame, path: str, pattern: str, end: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, start, ids): each text's tokens and the end token as two-byte ids, and where they start in
    the stream of their part; parts are ranges of the stream's order."""
    if max(end, _encoding(path, pattern).max_token_value) > 0xFFFF:
        raise ValueError("the vocabulary does not fit into two-byte ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = _encoding(path, pattern), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, starts = [], []
            for t in b.column(0).to_pylist():
                x = np.array([*enc.encode_ordinary(t or ""), end], dtype="<u2")
                ids.append(x.tobytes())
                starts.append(at)
                at += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["part", "start", "ids"])

    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    d = d.repartitionByRange(parts(docs.sparkSession), "id", "content").sortWithinPartitions("id", "content")
    return d.select("text").mapInArrow(run, "part int, start long, ids binary")


class Stream:
    """The settled token table of a run, with what follows from it and the parameters."""

    def __init__(self, docs: DataFrame, path: str, pattern: str, end: int, key: int, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = SLOTS_PER_SHARD):
        self.end, self.length, self.per_shard = end, length, per_shard
        self.table = settle(tokens(docs, path, pattern, end, id_col, text), "tokens", codec="zstd")
        tidy(docs.sparkSession)
        sizes = dict(self.table.groupBy("part").agg(F.sum(F.octet_length("ids") / 2).cast("long")).collect())  # one row for each part
        self.base, self.total = {}, 0
        for part in sorted(sizes):
            self.base[part], self.total = self.total, self.total + sizes[part]
        self.n = -(-self.total // length)
        self.shards = -(-self.n // per_shard)
        self.place = Feistel(self.n, key)


def identity(docs: DataFrame, path: str, pattern: str, end: int, key: int, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = SLOTS_PER_SHARD) -> str:
    """A digest of the rows, in any order, and of the parameters."""
    rows = docs.agg(F.count("*"), F.sum(F.xxhash64(id_col, text).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(text, id_col))).first()
    with open(path, "rb") as f:
        ranks = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(json.dumps([[str(x) for x in rows], ranks, pattern, end, key, length, per_shard]).encode()).hexdigest()


def sequences(stream: Stream, missing: DataFrame | None = None, wave: tuple[int, int] = (0, 1)) -> DataFrame:
    """One row per sequence, in ranges of slots: slot, sequence (its number in the stream), shard,
    byte_offset (in the shard), n_tokens (without filling), payload (length two-byte ids). With `missing`
    only those of its shards; with wave (k, of) only shards of which number % of is k."""
    spark = stream.table.sparkSession
    length, per_shard, n, end, place = stream.length, stream.per_shard, stream.n, stream.end, stream.place
    bases = spark.sparkContext.broadcast(stream.base)
    k_of, of = wave

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off, out = [], [], []
            for part, start, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, stop, done = bases.value[part] + start, bases.value[part] + start + len(ids) // 2, 0
                while at < stop:
                    s, o = divmod(at, length)
                    take = min(length - o, stop - at)
                    seq.append(s)
                    off.append(o)
                    out.append(ids[done : done + 2 * take])
                    at, done = at + take, done + 2 * take
            slot = place(np.array(seq, dtype=np.int64))
            pieces = pa.RecordBatch.from_arrays([pa.array(slot), pa.array(seq, pa.int64()), pa.array(off, pa.int32()), pa.array(out, pa.binary())], names=["slot", "sequence", "off", "ids"])
            yield pieces if of == 1 else pieces.filter(pa.array(slot // per_shard % of == k_of))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        pieces: list[bytes] = []
        rows: list[tuple[int, int, bytes]] = []

        def flush() -> pa.RecordBatch:
            slot, seq, raw = zip(*rows, strict=True)
            at = np.array(slot, dtype=np.int64)
            pad = np.array([end], dtype="<u2").tobytes()
            full = [x + pad * (length - len(x) // 2) for x in raw]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(seq, pa.int64()), pa.array(at // per_shard), pa.array(at % per_shard * 2 * length), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array(full, pa.binary())], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "payload"])

        for b in batches:
            for slot, seq, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held != (slot, seq):
                    if held is not None:
                        rows.append((*held, b"".join(pieces)))
                        if len(rows) >= 1024:
                            yield flush()
                    held, pieces = (slot, seq), []
                pieces.append(ids)
        if held is not None:
            rows.append((*held, b"".join(pieces)))
        if rows:
            yield flush()

    shards = max(1, stream.shards)
    dealt = stream.table.mapInArrow(cut, "slot long, sequence long, off int, ids binary").withColumn("shard", (F.col("slot") / per_shard).cast("int"))
    if missing is not None:
        dealt = dealt.join(missing.select("shard"), "shard", "left_semi").select("slot", "sequence", "off", "ids", "shard")
    if of > 1:
        dealt = dealt.repartitionById(-(-shards // of), F.expr(f"shard div {of}").cast("int"))
    else:
        dealt = dealt.repartitionById(shards, "shard")
    dealt = dealt.sortWithinPartitions("slot", "off").drop("shard")
    return dealt.mapInArrow(join, "slot long, sequence long, shard long, byte_offset long, n_tokens long, payload binary")


_MANIFEST = "identity string, shard long, first_slot long, n_slots long, bytes long, sha256 string, n_sequences long, n_tokens long"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What stands beside the shards of a folder."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard-*.json")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return spark.read.schema(_MANIFEST).json(f"{folder}/shard-*.json") if found else spark.createDataFrame([], _MANIFEST)


def write_shards(rows: DataFrame, folder: str, run: str, stream: Stream) -> DataFrame:
    """Write the output of `sequences` as files shard-00000000.bin and so on below `folder` (a URI
    that all executors reach), each with its JSON file; one row per shard as in `manifest`. Each
    range partition writes its own shard under a passing name and then renames it, so a task that
    runs again replaces the same bytes."""
    length, per_shard, n, total = stream.length, stream.per_shard, stream.n, stream.total

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        shard, first, count, out, digest = None, 0, 0, None, hashlib.sha256()
        name = temp = ""
        for b in batches:
            for slot, payload in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), strict=True):
                if shard is None:
                    shard, first = slot // per_shard, slot
                    name = f"{path}/shard-{shard:08d}"
                    temp = f"{name}.{TaskContext.get().taskAttemptId()}.part"
                    out = store.open_output_stream(temp)
                if slot != first + count or slot // per_shard != shard:
                    raise ValueError(f"slot {slot} follows {first + count - 1}")
                out.write(payload)
                digest.update(payload)
                count += 1
        if shard is not None:
            out.close()
            store.move(temp, f"{name}.bin")
            row = {"identity": run, "shard": shard, "first_slot": first, "n_slots": count, "bytes": count * 2 * length, "sha256": digest.hexdigest(), "n_sequences": n, "n_tokens": total}
            with store.open_output_stream(temp) as f:
                f.write(json.dumps(row).encode())
            store.move(temp, f"{name}.json")
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    return settle(rows.mapInArrow(write, _MANIFEST), "shards")


def materialise(docs: DataFrame, folder: str, path: str, pattern: str, end: int, key: int, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = SLOTS_PER_SHARD, waves: int = WAVES) -> DataFrame:
    """Write all shards of `docs` that `folder` does not have yet under this run's identity; the
    manifest rows of all of them, with `fresh` (written now)."""
    spark = docs.sparkSession
    run = identity(docs, path, pattern, end, key, id_col, text, length, per_shard)
    done = settle(manifest(spark, folder).where(F.col("identity") == run).dropDuplicates(["shard"]), "done")
    have, = done.agg(F.count("*")).first()
    needed = done.select("n_sequences").first()
    if have and have == -(-needed[0] // per_shard):
        return done.withColumn("fresh", F.lit(False))
    stream = Stream(docs, path, pattern, end, key, id_col, text, length, per_shard)
    missing = spark.range(stream.shards).select(F.col("id").cast("int").alias("shard")).join(done.select("shard"), "shard", "left_anti") if have else None
    out = done.withColumn("fresh", F.lit(False))
    for k in range(waves):
        out = out.unionByName(write_shards(sequences(stream, missing, (k, waves)), folder, run, stream).withColumn("fresh", F.lit(True)))
        tidy(spark)
    drop(stream.table)
    return out


def read_shards(made: DataFrame, folder: str, key: int, length: int = LENGTH, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """Read the shards of manifest rows from first to last by their stride: slot, sequence, shard,
    byte_offset, n_tokens (without filling), payload. A file whose digest is not the manifest's is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for shard, first, n_slots, sha, n, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place, digest = Feistel(n, key), hashlib.sha256()
                with store.open_input_stream(f"{path}/shard-{shard:08d}.bin") as f:
                    for at in range(0, n_slots, 256):
                        take = min(256, n_slots - at)
                        raw = f.read(take * 2 * length)
                        digest.update(raw)
                        slot = np.arange(first + at, first + at + take)
                        seq = place.inverse(slot)
                        payload = [raw[k : k + 2 * length] for k in range(0, len(raw), 2 * length)]
                        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(seq), pa.array(np.full(take, shard)), pa.array((slot - first) * 2 * length), pa.array(np.where(seq == n - 1, total - (n - 1) * length, length)), pa.array(payload, pa.binary())], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "payload"])
                if digest.hexdigest() != sha:
                    raise ValueError(f"shard {shard} has other bytes than its manifest says")

    rows = made.select("shard", "first_slot", "n_slots", "sha256", "n_sequences", "n_tokens")
    return rows.repartition(parts(made.sparkSession), "shard").mapInArrow(run, "slot long, sequence long, shard long, byte_offset long, n_tokens long, payload binary")
