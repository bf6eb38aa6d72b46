"""Language-model scoring with a log-bilinear model.

Tokens are the lower-cased (A-Z) words of a text and one end token. Training documents are those
whose crc32 of the id as text, modulo FOLDS, is not HELD_OUT. Token counts over all of them are
summed by Spark; from these come the base score (a smoothed unigram) and the vocabulary: the VOCAB
most frequent tokens have a class of their own, all others share class 0.

The model predicts a class from the two before it: the prediction vector is the sum of the context
vectors, each weighted per position and dimension; a class scores its target vector's product with
it, plus a bias. It is trained by noise-contrastive estimation in numpy, data-parallel: a hash of id
and text deals the training documents to pieces of about PIECE tokens, whose number follows from
the counts, and a piece's documents come in the order of that hash; so neither files nor splits nor
batches change what a piece sees. Each piece is trained on by itself from the same start, and Spark
averages the parameters by the tokens they saw; each of ROUNDS rounds uses other pieces, so that
each document is used once. For scoring, the products of a context with all classes are normalised
by their sum (batched matrix products, remembered per context), so log-probabilities are proper. A
token of class 0 counts with the class's probability times its smoothed share among such tokens.

Frequent tokens (HEAD of them) are looked up in the task; the rest are joined with their counts by
Spark. Null and empty texts consist of the end token alone; a null id counts as the empty text. Rows
that repeat an id are scored each by itself. Without training documents every count is zero. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import drop, parts, settle
from lodestone.llm.textkit import Words, lists, signed, words_of

FOLDS, HELD_OUT = 5, 1
#: Classes with a vector, frequent tokens that every task looks up, dimensions, rounds.
VOCAB, HEAD, DIMS, ROUNDS = 1000, 65_536, 32, 2
BATCH, NOISE, RATE = 1024, 96, 0.1
END = np.uint64(0x5E17E4CE0FF1CE00)
OTHER, START = 0, 1
#: Tokens of a piece of the training documents on average, tokens that are shuffled together.
PIECE, CHUNK = 1 << 20, 1 << 16
#: Distinct tokens that a task counts before it hands them on.
HELD_COUNTS = 1_000_000


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _with_end(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by the end token, and where each text begins."""
    first = w.first + np.arange(len(w.first))
    out = np.full(len(w.hash) + len(w.count), END, dtype=np.uint64)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    return out, first


def counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, c) over all texts of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.RecordBatch:
            token = np.concatenate([t for t, _ in held])
            c = np.concatenate([n for _, n in held])
            order = np.argsort(token, kind="stable")
            token = token[order]
            at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            out = (token[at], np.add.reduceat(c[order], at))
            held[:] = [out]
            return pa.RecordBatch.from_arrays([pa.array(signed(out[0])), pa.array(out[1])], names=["token", "c"])

        for b in batches:
            for _, w in words_of(b.column(0)):
                held.append(np.unique(_with_end(w)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 2 * HELD_COUNTS:
                    out = merged()
                    size = out.num_rows
                    if size > HELD_COUNTS:
                        held.clear()
                        size = 0
                        yield out
        if held:
            yield merged()

    return docs.select(text).mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def frequent(counted: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n of the most frequent tokens and their counts, the most frequent first. Two histograms
    of bounded size find the least count, so that only these tokens reach the driver: levels of counts
    (16 to a doubling) that fit are whole, of the next one tokens are taken by the order of their hashes."""
    level, part = F.floor(F.log2("c") * 16), F.shiftrightunsigned("token", 52)

    def fitting(hist: dict[int, int], keys: list[int], room: int) -> tuple[int | None, int]:
        """The first key that doesn't fit, if any, and the room that is left before it."""
        for k in keys:
            if hist[k] > room:
                return k, room
            room -= hist[k]
        return None, room

    hist = {r["k"]: r["count"] for r in counted.groupBy(level.alias("k")).count().collect()}
    last, room = fitting(hist, sorted(hist, reverse=True), n)
    chosen = F.lit(True)
    if last is not None:
        hist = {r["k"]: r["count"] for r in counted.where(level == last).groupBy(part.alias("k")).count().collect()}
        chosen = (level > last) | ((level == last) & (part < fitting(hist, sorted(hist), room)[0]))
    top = counted.where(chosen).toPandas().sort_values(["c", "token"], ascending=[False, True])
    return top["token"].to_numpy(dtype=np.int64).view(np.uint64), top["c"].to_numpy(dtype=np.int64)


class Lookup:
    """The most frequent tokens with their counts and classes."""

    def __init__(self, tokens: np.ndarray, c: np.ndarray, vocab: int):
        order = np.argsort(tokens)
        self.tokens, self.c = tokens[order], c[order]
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[order] = np.arange(len(tokens))
        self.cls = np.zeros(len(tokens), dtype=np.int64)
        self.cls[rank[:vocab]] = np.arange(2, 2 + min(vocab, len(tokens)))
        self.size = 2 + min(vocab, len(tokens))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: whether it is here, its count, its class."""
        if not len(self.tokens):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        here = self.tokens[at] == h
        return here, np.where(here, self.c[at], 0), np.where(here, self.cls[at], OTHER)


def contexts(cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; START before a text."""
    one, two = np.full(len(cls), START), np.full(len(cls), START)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    starts = first[:-1]
    one[starts] = START
    two[starts] = START
    second = starts + 1
    two[second[second < first[1:]]] = START
    return one, two


class Model:
    """Target vectors q, context vectors r, position weights c1 and c2, biases b."""

    NAMES = ("q", "r", "c", "b")

    def __init__(self, q, r, c, b):
        self.q, self.r, self.c, self.b = (np.array(x, dtype=np.float32) for x in (q, r, c, b))
        self.norm: np.ndarray | None = None

    @classmethod
    def start(cls, share: np.ndarray, dims: int = DIMS) -> Model:
        rng = np.random.default_rng(7)
        n = len(share)
        return cls(rng.normal(0, 0.1, (n, dims)), rng.normal(0, 0.1, (n, dims)), np.ones((2, dims)) * [[0.7], [0.3]], np.log(np.maximum(share, 1e-9)))

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[one] + self.c[1] * self.r[two]

    def log_prob(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of classes given their contexts."""
        n = len(self.b)
        if self.norm is None:
            self.norm = np.full(n * n, np.nan, dtype=np.float32)
        context = one * n + two
        distinct, where = np.unique(context * n + target, return_inverse=True)
        ctx, tgt = distinct // n, distinct % n
        new = np.unique(ctx[np.isnan(self.norm[ctx])])
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            s = self.predicted(part // n, part % n) @ self.q.T + self.b
            s[:, START] = -np.inf
            top = s.max(axis=1, keepdims=True)
            self.norm[part] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        out = np.empty(len(distinct), dtype=np.float64)
        for k in range(0, len(distinct), 65_536):
            c, t = ctx[k : k + 65_536], tgt[k : k + 65_536]
            out[k : k + 65_536] = np.einsum("ij,ij->i", self.predicted(c // n, c % n), self.q[t]) + self.b[t] - self.norm[c]
        return out[where]


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at = at[order]
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[cut]] += np.add.reduceat(rows[order], cut, axis=0)


class Trainer:
    """Noise-contrastive estimation with noise shared by a batch and AdaGrad steps."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.noise = share / share.sum()
        self.edges = np.cumsum(self.noise)
        self.log_noise = np.log(np.maximum(NOISE * self.noise, 1e-12)).astype(np.float32)
        self.past = {k: np.full_like(getattr(model, k), 1e-7) for k in Model.NAMES}

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, len(target)
        ra, rb = m.r[one], m.r[two]
        p = m.c[0] * ra + m.c[1] * rb
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        good = 1 - sigmoid(np.einsum("ij,ij->i", p, m.q[target]) + m.b[target] - self.log_noise[target])
        bad = -sigmoid(p @ m.q[noise].T + m.b[noise] - self.log_noise[noise])
        dp = good[:, None] * m.q[target] + bad @ m.q[noise]
        g = {k: np.zeros_like(getattr(m, k)) for k in Model.NAMES}
        _add_rows(g["q"], target, good[:, None] * p)
        np.add.at(g["q"], noise, bad.T @ p)
        g["b"] += np.bincount(target, weights=good, minlength=len(m.b)) + np.bincount(noise, weights=bad.sum(axis=0), minlength=len(m.b))
        _add_rows(g["r"], one, dp * m.c[0])
        _add_rows(g["r"], two, dp * m.c[1])
        g["c"][0], g["c"][1] = (dp * ra).sum(axis=0), (dp * rb).sum(axis=0)
        for k in Model.NAMES:
            x = g[k] / np.float32(n)
            self.past[k] += x * x
            getattr(m, k)[...] += RATE * x / np.sqrt(self.past[k])


def dealt(docs: DataFrame, id_col: str, text: str, look: Lookup, pieces: int) -> DataFrame:
    """(piece, key, classes): the classes of each document's tokens, and its place in the order of training."""
    given = docs.sparkSession.sparkContext.broadcast(look)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = given.value
        for b in batches:
            for at, w in words_of(b.column(1)):
                h, first = _with_end(w)
                key = b.column(0).slice(at, len(first) - 1)
                piece = np.asarray(key) % pieces
                yield pa.RecordBatch.from_arrays([pa.array(piece), key, lists(words.find(h)[2].astype(np.int32), np.diff(first), pa.int32())], names=["piece", "key", "classes"])

    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return docs.select(key.alias("key"), F.col(text)).mapInArrow(run, "piece long, key long, classes array<int>")


def _train_round(given_docs: DataFrame, model: Model, share: np.ndarray) -> Model:
    """Train on every piece of `given_docs` (as `dealt`) from `model` and average by tokens."""
    spark = given_docs.sparkSession
    given = spark.sparkContext.broadcast((model.q, model.r, model.c, model.b, share))
    dims = model.q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, r, c, b, p = given.value
        trainer, piece, first_piece = None, None, None
        held, size, seen, sums = [], 0, 0, 0.0

        def learn(least: int) -> None:
            """Train on the held tokens, CHUNK at a time, while there are `least` or more."""
            nonlocal held, size
            if size < least:
                return
            cls, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            done = 0
            while size and size >= least:
                n = min(size, CHUNK)
                order = done + trainer.rng.permutation(n)
                for k in range(0, n, BATCH):
                    at = order[k : k + BATCH]
                    trainer.step(cls[at], one[at], two[at])
                done, size = done + n, size - n
            held = [(cls[done:], one[done:], two[done:])] if size else []

        def closed() -> None:
            nonlocal sums
            learn(1)
            m = trainer.m
            sums = sums + here * np.concatenate([m.q, m.r, m.c, np.pad(m.b[:, None], ((0, 0), (0, dims - 1)))]).astype(np.float64)

        here = 0
        for batch in batches:
            pieces, col = np.asarray(batch.column(0)), batch.column(1)
            cuts = np.flatnonzero(np.diff(pieces)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pieces)], strict=True):
                if hi == lo:
                    continue
                if pieces[lo] != piece:
                    if trainer:
                        closed()
                    piece, here = int(pieces[lo]), 0
                    first_piece = piece if first_piece is None else first_piece
                    trainer = Trainer(Model(q, r, c, b), p, 1 + piece)
                part = col.slice(lo, hi - lo)
                cls = np.asarray(part.flatten()).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(np.asarray(part.value_lengths()))])
                held.append((cls, *contexts(cls, first)))
                size, here, seen = size + len(cls), here + len(cls), seen + len(cls)
                learn(CHUNK)
        if trainer:
            closed()
            k = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int64()), pa.array([float(seen)] * k), lists(sums.ravel(), np.full(k, dims), pa.float64()), pa.array([first_piece] * k, pa.int64())], names=["row", "weight", "vector", "piece"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(2).flatten()).reshape(b.num_rows, dims)
            full = np.concatenate([np.asarray(b.column(1))[:, None], v], axis=1)
            for row, x in zip(b.column(0).to_pylist(), full, strict=True):
                sums[row] = sums[row] + x if row in sums else x
        if sums:
            x = np.stack([sums[k] for k in sorted(sums)])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(sums), pa.int64()), pa.array(x[:, 0]), lists(x[:, 1:].ravel(), np.full(len(x), dims), pa.float64())], names=["row", "weight", "vector"])

    schema = "row long, weight double, vector array<double>"
    ordered = given_docs.repartition(parts(spark), "piece").sortWithinPartitions("piece", "key").select("piece", "classes")
    sums = ordered.mapInArrow(run, schema + ", piece long").repartition(parts(spark), "row").sortWithinPartitions("row", "piece")
    got = sums.mapInArrow(total, schema).collect()  # one row for each vector of the model
    if not got:
        return model
    got.sort(key=lambda x: x["row"])
    x = np.array([np.array(g["vector"]) / g["weight"] for g in got])
    n = len(model.b)
    return Model(x[:n], x[n : 2 * n], x[2 * n : 2 * n + 2], x[2 * n + 2 :, 0])


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocab: int = VOCAB, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    train = docs.where(~held_out(id_col))
    counted = settle(counts(train, text), "counts")
    n_all, v_all = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, c = frequent(counted, head)
    look = Lookup(tokens, c, vocab)
    n_own = int(c[:vocab].sum())
    n_other, v_other = n_all - n_own, v_all - min(vocab, len(c))
    share = np.zeros(look.size)
    share[2:] = c[:vocab]
    share[OTHER] = n_other + 1
    share /= share.sum()
    model = Model.start(share)
    pieces = rounds * -(-max(int(n_all), 1) // (rounds * PIECE))
    classes = settle(dealt(train, id_col, text, look, pieces), "classes")
    for k in range(rounds):
        model = _train_round(classes.where(F.col("piece") % rounds == k), model, share)
    drop(classes)
    base_all = float(np.log10(n_all + 0.5 * (v_all + 1)))
    base_other = float(np.log10(n_other + 0.5 * (v_other + 1)))
    given = spark.sparkContext.broadcast((model.q, model.r, model.c, model.b, look))
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"row long, `{id_col}` {kind}, held_out boolean, n_tokens long, n_head long, base double, model double, n_rare long, rare array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, r, cc, b, words = given.value
        m = Model(q, r, cc, b)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, w in words_of(batch.column(2)):
                h, first = _with_end(w)
                here, c, cls = words.find(h)
                one, two = contexts(cls, first)
                lp = m.log_prob(cls, one, two) / np.log(10)
                own = np.where(here, np.log10(c + 0.5), 0.0)
                lp += np.where(cls == OTHER, own - base_other, 0.0)
                sizes = np.diff(first)
                rare = ~here
                n_rare = np.add.reduceat(rare.astype(np.int64), first[:-1])
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + k)), batch.column(0).slice(at, k), batch.column(1).slice(at, k), pa.array(sizes.astype(np.int64)), pa.array(sizes - n_rare), pa.array(np.add.reduceat(own, first[:-1]) - sizes * base_all), pa.array(np.add.reduceat(lp, first[:-1])), pa.array(n_rare), lists(signed(h[rare]), n_rare, pa.int64())], names=["row", id_col, "held_out", "n_tokens", "n_head", "base", "model", "n_rare", "rare"])
                row += k

    scored = settle(docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text)).mapInArrow(run, fields), "scored")
    rare = scored.select("row", F.explode("rare").alias("token")).join(counted, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.count("c").alias("known"))
    both = scored.drop("rare").join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(id_col, "held_out", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))
