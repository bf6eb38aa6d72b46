"""The ten operators against brute-force versions on small tables with nulls, empty texts, repeated
rows, ties and extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bilinear, decontaminate, line_templates, ngram_join, quality_rules, reply_trees, sentence_pieces, suffix_dedup, training_order, url_trust
from lodestone.llm.tables import components
from lodestone.llm.textkit import words_of

WORD = re.compile("[^\x20\x09-\x0d]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def some_texts(seed: int = 3, n: int = 40) -> list[str | None]:
    r = random.Random(seed)
    vocab = ["the", "Of", "und", "être", "日本", "x", "and", "#tag", "12", "line", "\u00a0odd", "A"]
    texts: list[str | None] = [" ".join(r.choice(vocab) + r.choice(["", ".", "s", "7"]) for _ in range(r.randint(1, 120))).replace(" line", "\n") for _ in range(n)]
    base = " ".join(f"w{k % 37}{k}" for k in range(150))
    near = base.split(" ")
    near[70] = "changed"
    texts += [None, "", "  \n\t ", "one", "two words", base, base, " ".join(near), base + " tail of it", "x" * 5000, texts[0], texts[1]]
    return texts


def docs(spark, texts, **more):
    rows = [(k, t) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return d.withColumns({k: F.lit(v) for k, v in more.items()})


CLASH = {"id": "a", "node": "b", "n": 1, "content": "c", "start": 2, "h": 3, "row": 4, "kept": 5, "seed": 6, "tokens": 7, "n_words": 8, "host": "h", "path": "p", "key": "k"}


@pytest.fixture(scope="module")
def texts():
    return some_texts()


@pytest.fixture(scope="module")
def table(spark, texts):
    return docs(spark, texts, **CLASH).cache()


def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    got = []
    for _, w in words_of(pa.array(texts)):
        raw = w.data.tobytes()
        for k in range(len(w.count)):
            got.append([raw[a:b].decode() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]], strict=True)])
    assert got == [WORD.findall(lower(t or "")) for t in texts]


def test_components_of_random_graphs(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert got == {x: find(x) for x in parent if x in got}
    assert set(parent) - set(got) <= alone
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 chat formatting
def test_reply_trees(spark):
    rows = [(1, 0, None, 0.0, "user", "root"), (1, 1, 0, 1.0, "assistant", "a"), (1, 2, 0, 3.0, "assistant", "b</s>[INST"), (1, 3, 2, 3.0, "user", "c\\x"), (1, 4, 1, 9.0, "user", "d"), (1, 4, 1, 9.0, "user", "d"),
            (2, 10, 11, 0.0, "user", "cycle"), (2, 11, 10, 0.0, "user", "cycle"), (2, 12, 11, 0.0, "user", "below"), (3, 5, 99, None, None, None), (None, 1, None, 1.0, "user", "null tree"), (4, None, None, 1.0, "user", "no id")]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string").withColumns({"steps": F.lit(1), "up": F.lit(2)})
    got = {(r.tree, r.rank): (r.leaf, r.n_turns, r.formatted) for r in reply_trees.conversations(m, best=2).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): 4, (1, 2): 3, (3, 1): 5, (None, 1): 1}
    assert got[(1, 2)][2] == "[TURN]user[/TURN]root</s>\n[TURN]assistant[/TURN]b<\\/s>[INST</s>\n[TURN]user[/TURN]c\\\\x</s>\n"
    assert reply_trees.conversations(m.limit(0)).count() == 0


def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = [*reply_trees.CONTROL, "\\", "<", "[", "</", "text", "\n", "é", "]", "s>", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "</s>"]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for c in range(12) for t in range(r.randint(1, 20))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = reply_trees.conversations(reply_trees.linear(d, "conv_id", "turn"))
    out = out.select("tree", "formatted", reply_trees.parse(F.col("formatted")).alias("turns"), reply_trees.under_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    for x in out.collect():
        mine = [(b, c) for a, _, b, c in rows if a == x.tree]
        assert [(t.role, t.text) for t in x.turns] == mine
        assert x.learned == "".join(t for role, t in mine if role == "assistant")
        assert x.formatted.count("</s>") == len(mine)


# 2 n-gram join
def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b]:
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                        label[a] = label[b] = min(label[a], label[b])
    return {k: (len(s), label[k]) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_ngram_join(spark, table, texts, width, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(table, width=width, num=num, den=den).collect()}
    assert got == brute_components(texts, width, num, den)


def test_ngram_join_of_near_copies_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    r = random.Random(9)
    base = [f"w{r.randrange(400)}" for _ in range(90)]
    texts = []
    for _ in range(60):
        x = list(base)
        for _ in range(r.randint(0, 4)):
            x[r.randrange(90)] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(x))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_components(docs(spark, texts), width=4, num=85, den=100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_blocks_outnumber_differences():
    rule = ngram_join.Threshold(85, 100)
    bands = rule.bands(3000)
    for b, (low, high) in enumerate(zip(bands[:-1], bands[1:], strict=True)):
        m, spare = rule.blocks(int(low), int(high))
        for small in {int(low), int(high) - 1}:
            for large in range(small, small * 100 // 85 + 1):
                differ = small + large - 2 * int(rule.needed(small + large))
                assert differ < m - spare or (m == 0 and differ <= 0)
                assert int(np.searchsorted(bands, large, side="right")) - 1 - b in (0, 1)


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("doc_id < 0")
    items = none.withColumnRenamed("doc_id", "item_id")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert ngram_join.link_components(none).count() == 0
    assert suffix_dedup.clean(none).count() == 0
    assert sentence_pieces.round_trip(none, MODEL).count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert line_templates.without_recurring_lines(none).count() == 0
    assert bilinear.score(none).count() == 0
    assert training_order.sequences(training_order.Stream(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256, 1)).count() == 0
    assert url_trust.judge(spark.createDataFrame([], "page_id long, url string, html string"), []).count() == 0


# 3 suffix arrays
def brute_removed(texts):
    first, out = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if b else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, table, texts):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.clean(table).collect()}
    assert got == brute_removed(texts)


@pytest.mark.parametrize("crowd", [1, 20_000])
def test_suffix_dedup_of_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "PART_RUNS", crowd)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    parts = [" ".join(word() for _ in range(r.randint(12, 60))) for _ in range(6)]
    texts = [" ".join(x for _ in range(4) for x in (word() * r.randint(1, 30), r.choice(parts)[r.randrange(20) :])) for _ in range(50)] + ["a" * 300, "a" * 120, "ab" * 100]
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.clean(docs(spark, texts)).collect()}
    assert got == brute_removed(texts)


def test_two_stage_order():
    r = random.Random(2)
    for _ in range(20):
        strings = [bytes(r.choice(b"aab\x00\xff") for _ in range(r.randint(0, 90))) for _ in range(8)]
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes + 1) - 1
        text = np.full(int(ends[-1]) + 1, -1, dtype=np.int16)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8)
        order = suffix_dedup.two_stage(text, ends)
        key = [tuple(text[k : k + 1 + int(ends[np.searchsorted(ends, k)]) - k][:50]) for k in order]
        assert sorted(order.tolist()) == list(range(len(text)))
        assert key == sorted(key)


@pytest.mark.parametrize("flags", [b"\x12\x00\x18\x00\x20\x00", b"\x12\x00\x18\x01\x20\x01", b"\x12\x02xy\x18\x01"])
def test_other_models_are_errors(tmp_path, flags):
    raw = open(MODEL, "rb").read()
    known = b"\x12\x00\x18\x01\x20\x00"
    assert raw.count(known) == 1 and len(flags) == len(known)
    path = tmp_path / "other.model"
    path.write_bytes(raw.replace(known, flags))
    with pytest.raises(ValueError, match="supported"):
        sentence_pieces.PieceModel(str(path))


# 4 SentencePiece
def test_sentence_pieces(spark, table, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    m = sentence_pieces.model(MODEL)
    r = random.Random(8)
    odd = ["a", " ", "  ", "▁", "\n", "th", "the", "é", "日", "𝄞", "\t", "<s>", "▁" * 20, "==", "ation", "\x00"]
    for t in [x or "" for x in texts] + ["".join(r.choice(odd) for _ in range(r.randint(0, 25))) for _ in range(2000)]:
        ids = sp.encode(t)
        assert m.encode(t) == ids
        assert m.decode(ids) == sp.decode(ids)
    for _ in range(500):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(32000)]) for _ in range(5)]
        assert m.decode(ids) == sp.decode(ids)
    for t in ["".join(r.choice("theationsé日") for _ in range(30_000)), "=" * 20_000, "ab" * 10_000, " " * 10_000 + "x"]:
        assert m.encode(t) == sp.encode(t)
    both = sentence_pieces.decode(sentence_pieces.encode(table, MODEL), MODEL)
    assert all(r.token_ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.token_ids) for r in both.collect())
    with pytest.raises(ValueError, match="exist already"):
        sentence_pieces.encode(table.withColumn("token_ids", F.lit(1)), MODEL)


# 5 quality rules
def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    full = [x for x in t.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeated = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(repeated))


def test_quality_statistics(spark, texts):
    more = [*texts, "a b c d e f g h i a b c d e f g h z", "x\nx\n \n \ny\nx ", "w " * 40]
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.statistics(docs(spark, more, **CLASH)).collect()}
    assert got == {k: brute_counts(t) for k, t in enumerate(more)}


def test_decision_list_rejects_the_planted_kind(spark):
    r = random.Random(6)
    good = [" ".join(f"word{r.randrange(900)}" for _ in range(40)) for _ in range(300)]
    bad = [" ".join(f"w{r.randrange(900)}{'#$' * 2}" for _ in range(40)) for _ in range(100)]
    d = docs(spark, good + bad, kept=True, n_words=0)
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(0, 400, 2)] + [(None, 1), (4, None)], "doc_id long, quality int")
    kept = {x.doc_id for x in quality_rules.keep(d, labels).select("doc_id").collect()}
    assert kept == set(range(300))
    one = labels.where("quality = 1")
    assert quality_rules.keep(d, one).count() == 400
    rules = quality_rules.fit(d, labels)
    assert rules.rules and all(len(x.conditions) <= 4 for x in rules.rules)


# 6 decontamination
def test_leaks(spark):
    r = random.Random(7)
    word = lambda: f"t{r.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (30, 15, 12, 8, 5, 40, 40)] + [[], None, [word()]]
    items[6][:20] = items[5][:20]
    texts = []
    for k in range(60):
        t = [word() for _ in range(80)]
        it = items[k % 7]
        part = list(it[: r.randint(6, len(it))]) if len(it) > 6 else list(it)
        for _ in range(r.randint(0, 4)):
            part[r.randrange(len(part))] = "SUBST"
        t[20:20] = part
        texts.append(" ".join(x.upper() if r.random() < 0.3 else x for x in t).replace(" ", ", ", 9))
    texts += [None, "", "short"]
    clean = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
    expected = set()
    for i, t in enumerate(texts):
        w = clean.findall(lower(t or ""))
        for j, it in enumerate(items):
            n = len(it or [])
            if 1 <= n < 12:
                hit = any(w[k : k + n] == it for k in range(len(w)))
            else:
                hit = n >= 12 and any(sum(x == y for x, y in zip(w[a : a + 12], it[b : b + 12], strict=True)) >= 10 for a in range(len(w) - 11) for b in range(n - 11))
            if hit:
                expected.add((i, j))
    bench = spark.createDataFrame([(k, None if x is None else " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    d = docs(spark, texts, **CLASH)
    got = decontaminate.leaks(d, bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == expected
    left = decontaminate.clean(d, bench)
    assert left.columns == d.columns
    assert {x.doc_id for x in left.select("doc_id").collect()} == set(range(len(texts))) - {i for i, _ in expected}


# 7 line templates
def test_line_templates(spark):
    r = random.Random(3)
    say = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(9))
    texts = [f"{say()}\nPosted on 2021-0{k % 9 + 1}-11 by user number {k}\n{say()}\nAll rights reserved\n{say()}" for k in range(25)]
    copy = "\n".join(say() for _ in range(5))
    texts += [copy] * 30 + [copy + f"\nmy own end {k} x" for k in range(30)] + [None, "", "\n\n", "ok ok"]
    out = line_templates.without_recurring_lines(docs(spark, texts, **CLASH)).collect()
    for x in out:
        t = texts[x.doc_id]
        if x.doc_id < 25:
            assert x.n_dropped_lines == 2
            assert x.text == "\n".join(t.split("\n")[k] for k in (0, 2, 4))
        else:
            assert (x.n_dropped_lines, x.text) == (0, t)


def test_lines_that_recur_literally(spark):
    r = random.Random(4)
    say = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(9))
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    again = "see all of the other fine pages that we have here for you"
    codes = "11 22 33 44 call 55 66"
    short = ["Menu", "版权所有"]
    texts = ["\n".join([say(), say(), again, codes, *short, say(), say(), say(), say(), say()]) for _ in range(20)]
    texts += [f"{say()}\nsee all of the " + " ".join(word() for _ in range(8)) + f"\n{say()}" for _ in range(40)]
    out = {x.doc_id: x for x in line_templates.without_recurring_lines(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        kept = [x for x in t.split("\n") if k >= 20 or x not in (again, codes, *short)]
        assert (out[k].text, out[k].n_dropped_lines) == ("\n".join(kept), 4 if k < 20 else 0)


def test_lines_beside_a_group_of_copies(spark):
    r = random.Random(5)
    say = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(9))
    line, stamped = "All rights are reserved by us", "Number {} of all the rights reserved"
    shared = [say() for _ in range(12)]
    texts = ["\n".join([say(), say(), line, stamped.format(k), say(), say(), say()]) for k in range(20)]
    texts += ["\n".join([*shared, line, stamped.format(100 + k), f"{word} end of it"]) for k, word in enumerate("".join(r.choice("abcdef") for _ in range(9)) for _ in range(150))]
    out = {x.doc_id: x for x in line_templates.without_recurring_lines(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert not {line} & set(out[k].text.split("\n")) and "Number" not in out[k].text
        assert k < 20 or out[k].text.split("\n")[:12] == shared


# 8 training order
def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        a = training_order.Feistel(n, 5)(np.arange(n))
        assert sorted(a.tolist()) == list(range(n))
    assert training_order.Feistel(1000, 5)(np.arange(1000)).tolist() != training_order.Feistel(1000, 6)(np.arange(1000)).tolist()


def plain_stream(path, rows, length):
    """The stream cut into sequences, by plain Python: rows (id, hash of the text, text)."""
    enc = training_order._encoding(path, public_tokenizers.PATTERN)
    stream = [i for _, _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for i in [*enc.encode_ordinary(t or ""), 50256]]
    return [np.array(stream[k : k + length] + [50256] * (k + length - len(stream)), dtype="<u2").tobytes() for k in range(0, len(stream), length)], len(stream)


BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def written(d, folder, key):
    made = training_order.materialise(d, f"file://{folder}", BPE, public_tokenizers.PATTERN, 50256, key, length=16, per_shard=10)
    return made, training_order.read_shards(made, f"file://{folder}", key, 16, 10)


def test_shards_equal_a_plain_stream(spark, table, tmp_path):
    twice = table.unionByName(table.where("doc_id < 3").withColumn("text", F.concat("text", F.lit(" again")))).unionByName(table.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    sequences, n_tokens = plain_stream(BPE, [tuple(r) for r in twice.select("doc_id", F.xxhash64("text"), "text").collect()], 16)
    place = training_order.Feistel(len(sequences), 3)(np.arange(len(sequences)))
    made, back = written(twice, tmp_path, 3)
    rows = sorted(tuple(r) for r in back.collect())
    expected = sorted((int(s), k, int(s) // 10, int(s) % 10 * 32, 16 if k < len(sequences) - 1 else n_tokens - 16 * k, sequences[k]) for k, s in enumerate(place))
    assert [(*r[:5], bytes(r[5])) for r in rows] == expected
    for m in made.collect():
        raw = (tmp_path / f"shard-{m.shard:08d}.bin").read_bytes()
        assert m.fresh and hashlib.sha256(raw).hexdigest() == m.sha256 and raw == b"".join(e[5] for e in expected if e[2] == m.shard)


def test_shards_resume_and_are_never_stale(spark, table, tmp_path):
    made, _ = written(table, tmp_path, 3)
    first = {m.shard: m.sha256 for m in made.collect()}
    assert written(table.repartition(7), tmp_path, 3)[0].where("fresh").count() == 0
    lost = sorted(first)[::3]
    for k in lost:  # a run that was killed halfway has no JSON file for these, and perhaps half a shard
        (tmp_path / f"shard-{k:08d}.json").unlink()
        (tmp_path / f"shard-{k:08d}.bin").write_bytes(b"half")
    made, back = written(table, tmp_path, 3)
    assert sorted(m.shard for m in made.where("fresh").collect()) == lost
    assert {m.shard: m.sha256 for m in made.collect()} == first and back.count() > 0
    made, back = written(table, tmp_path, 4)
    assert made.where("not fresh").count() == 0 and {m.shard: m.sha256 for m in made.collect()} != first
    assert back.count() == made.agg(F.sum("n_slots")).first()[0]
    with pytest.raises(ValueError, match="two-byte"):
        training_order.tokens(table, BPE, public_tokenizers.PATTERN, 70_000)


# 9 URL filters
def test_url_rules_and_trust(spark):
    rules = [url_trust.UrlRule("block", "com", "/en/"), url_trust.UrlRule("allow", "example.com", "/en/7"), url_trust.UrlRule("block", "bad.org", "/"), url_trust.UrlRule("allow", "good.org", "/")]
    link = lambda h: f'<p><a class="x" href="http://{h}/q">x</a>'
    rows = [(0, "http://Example.com/en/77?q", None), (1, "https://x.com/en/1", ""), (2, "ftp://ab.com#/en/", ""), (3, None, "x"), (4, "no scheme", "x"), (5, "http://bad.org/a", ""), (6, "http://good.org/a", link("friend.net")), (7, "http://friend.net/z", ""), (8, "http://farm.net/z", link("bad.org")), (9, "http://far.net/", link("farm.net")), (9, "http://far.net/", link("farm.net")), (10, "http://alone.net?x://y", ""), (11, "http://sub.farm.net/", "")]
    got = [tuple(r)[:5] for r in url_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rank", F.lit(1)), rules).orderBy("page_id").collect()]
    assert got == [(0, "example.com", "/en/77", "example.com/en/7", "allow"), (1, "x.com", "/en/1", "com/en/", "block"), (2, "ab.com", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "bad.org", "/a", "bad.org/", "block"), (6, "good.org", "/a", "good.org/", "allow"), (7, "friend.net", "/z", None, "allow"), (8, "farm.net", "/z", None, "block"), (9, "far.net", "/", None, "block"), (9, "far.net", "/", None, "block"), (10, "alone.net", "", None, "allow"), (11, "sub.farm.net", "/", None, "block")]


def test_page_rank_against_numpy(spark):
    edges = [("trust", "a", "b", 0.5), ("trust", "a", "c", 0.5), ("trust", "b", "c", 1.0), ("trust", "d", "a", 1.0)]
    got = {r.host: r["rank"] for r in url_trust.spread(spark.createDataFrame([("trust", "a", 0.75), ("trust", "d", 0.25)], "kind string, host string, seed double"), spark.createDataFrame(edges, "kind string, src string, dst string, p double")).collect()}
    names = "abcd"
    m = np.zeros((4, 4))
    for _, s, t, p in edges:
        m[names.index(t), names.index(s)] = p
    seed = np.array([0.75, 0, 0, 0.25])
    x = seed.copy()
    for _ in range(url_trust.STEPS):
        flows = m.sum(axis=0) > 0
        x = 0.85 * m @ x + seed * ((0.15 * x[flows]).sum() + x[~flows].sum())
    assert all(math.isclose(got.get(k, 0.0), v, abs_tol=1e-12) for k, v in zip(names, x, strict=True))


def test_trust_reaches_a_fixed_point(spark):
    edges = [("trust", "a", "b", 0.5), ("trust", "a", "c", 0.5), ("trust", "b", "c", 1.0), ("trust", "d", "a", 1.0), ("trust", "c", "h0", 1.0)] + [("trust", f"h{k}", f"h{k + 1}", 1.0) for k in range(20)]
    got = {r.host: r["rank"] for r in url_trust.fixed_point(spark.createDataFrame([("trust", "a", 0.75), ("trust", "d", 0.25)], "kind string, host string, seed double"), spark.createDataFrame(edges, "kind string, src string, dst string, p double")).collect()}
    names = [*"abcd", *(f"h{k}" for k in range(21))]
    m = np.zeros((25, 25))
    for _, s, t, p in edges:
        m[names.index(t), names.index(s)] = p
    seed = np.zeros(25)
    seed[0], seed[3] = 0.75, 0.25
    back = np.where(m.sum(axis=0) > 0, 0.15, 1.0)
    x = np.linalg.solve(np.vstack([(np.eye(25) - 0.85 * m - np.outer(seed, back))[:-1], np.ones(25)]), np.eye(25)[-1])
    assert len(got) == 25 and all(math.isclose(got[k], v, rel_tol=1e-7) for k, v in zip(names, x, strict=True))


def test_spam_at_the_end_of_a_long_chain(spark):
    link = lambda h: f'<a href="http://{h}/q">x</a>'
    rows = [(0, "http://bad.org/", "")] + [(k, f"http://h{k}.net/", link(f"h{k - 1}.net" if k > 1 else "bad.org")) for k in range(1, 15)]
    got = url_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), [url_trust.UrlRule("block", "bad.org", "/")]).collect()
    assert len(got) == 15 and {r.verdict for r in got} == {"block"}


# 10 language model
def test_base_scores(spark, table, texts):
    got = {r.doc_id: r for r in bilinear.score(table, vocab=20, head=50).collect()}
    toks = [WORD.findall(lower(t or "")) + [None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    c = collections.Counter(w for x, h in zip(toks, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    for k, x in enumerate(toks):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9)
        assert r.score < 0


def test_scores_do_not_depend_on_splits(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "PIECE", 700)
    monkeypatch.setattr(bilinear, "CHUNK", 128)
    made = docs(spark, some_texts(8, 60))
    got = []
    for n, size in ((1, "10000"), (7, "3")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append({r.doc_id: r.score for r in bilinear.score(made.repartition(n, F.hash("doc_id") + n), vocab=20, head=50).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0].keys() == got[1].keys() and all(math.isclose(got[0][k], v, rel_tol=1e-9) for k, v in got[1].items())


def test_frequent_tokens(spark):
    r = np.random.default_rng(5)
    rows = [(int(t), 1 + k // 40) for k, t in enumerate(r.integers(-(2**63), 2**63 - 1, 400))]
    made = spark.createDataFrame(rows, "token long, c long")
    best = sorted(rows, key=lambda x: (-x[1], x[0]))
    for n in (0, 1, 90, 400, 1000):
        tokens, c = bilinear.frequent(made, n)
        got = list(zip(tokens.view(np.int64).tolist(), c.tolist(), strict=True))
        assert len(got) <= n and len(got) >= min(n, 400) - 1
        assert [x[1] for x in got] == [x[1] for x in best[: len(got)]] and set(got) <= set(rows)
    assert [len(x) for x in bilinear.frequent(made.limit(0), 5)] == [0, 0]


def test_model_is_normalised_and_learns():
    r = np.random.default_rng(0)
    n = 40
    nxt = r.permutation(np.arange(2, n))
    share = np.full(n, 1.0 / n)
    share[bilinear.START] = 0
    m = bilinear.Model.start(share, 16)
    t = bilinear.Trainer(m, np.maximum(share, 1e-9), 1)
    seq = np.empty(60_000, dtype=np.int64)
    seq[0] = 2
    for k in range(1, len(seq)):
        seq[k] = nxt[seq[k - 1] - 2] if r.random() < 0.8 else r.integers(2, n)
    one, two = bilinear.contexts(seq, np.array([0, len(seq)]))
    before = m.log_prob(seq, one, two).mean()
    m.norm = None
    for _ in range(4):
        for k in range(0, len(seq), 512):
            t.step(seq[k : k + 512], one[k : k + 512], two[k : k + 512])
    assert m.log_prob(seq, one, two).mean() > before + 0.8
    every = np.arange(n)
    total = np.exp(m.log_prob(every[every != bilinear.START], np.full(n - 1, 5), np.full(n - 1, 9))).sum()
    assert abs(total - 1) < 1e-4


def test_plans_of_ranks_are_short(spark, monkeypatch):
    """The driver holds a plan and its code: no plan has all the steps between two looks."""
    joins, settle = [], url_trust.settle
    monkeypatch.setattr(url_trust, "settle", lambda df, name: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or settle(df, name))
    edges = [("trust", "a", "b", 1.0), ("trust", "b", "c", 1.0), ("trust", "c", "a", 1.0)]
    ranks = url_trust.fixed_point(spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double"), spark.createDataFrame(edges, "kind string, src string, dst string, p double")).collect()
    assert math.isclose(sum(r["rank"] for r in ranks), 1.0, rel_tol=1e-9) and 1 <= max(joins) <= 3
