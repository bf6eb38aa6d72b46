"""Each stage of the pipeline against a plain version, on documents with nulls, empty and long texts,
repeated rows and ids, ties, and columns whose names clash with those of the operators."""

from __future__ import annotations

import collections
import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import line_templates, quality_rules
from tests.llm.test_operators import CLASH, MODEL, WORD, brute_components, brute_counts, lower

STAGES = dict(corpus_pipeline.STAGES)


def words(r, n, of=3000):
    return " ".join(f"t{r.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with labels and benchmark, and the documents' rows."""
    r = random.Random(12)
    items = [words(r, 30) for _ in range(3)] + ["only five words of it", None, ""]
    rows = []
    for k in range(60):
        rows.append((k, "\n".join(words(r, 30) for _ in range(4)) + ("\nPage number 7 of our site" if k % 3 == 0 else "") + ("\nPosted on day %d by us" % k if k % 4 == 0 else "")))
    rows += [(60 + k, words(r, 60).replace(" ", "#$ ")) for k in range(30)]
    base = words(r, 200).split(" ")
    for k in range(12):
        near = list(base)
        near[k * 7] = "edit"
        rows.append((100 + k, " ".join(near)))
    rows += [(120, rows[0][1]), (121, words(r, 20) + " " + items[0] + " " + words(r, 20)), (122, words(r, 25) + " Only, five words of it " + words(r, 9)), (123, "x" * 30_000 + " " + words(r, 30)), (124, None), (125, ""), (126, "few words"), (127, "same again " * 60)]
    rows += [(5, rows[5][1]), (6, words(r, 130)), (None, words(r, 40)), (None, rows[0][1]), (None, None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, 0 if 60 <= k < 90 else 1, 0) for k in range(0, 90)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).withColumns({k: F.lit(v) for k, v in CLASH.items()})
    d.write.parquet(f"{folder}/documents.parquet")
    return str(folder), spark.read.parquet(f"{folder}/documents.parquet")


def pairs(df):
    return collections.Counter((x.doc_id, x.text) for x in df.select("doc_id", "text").collect())


def keeps_columns(stage, spark, d, folder):
    out = STAGES[stage](spark, d, folder)
    assert out.columns == d.columns
    assert STAGES[stage](spark, d.limit(0), folder).count() == 0
    return out


def test_quality(spark, sf):
    folder, d = sf
    got = pairs(keeps_columns("quality", spark, d, folder))
    rules = quality_rules.fit(d, spark.read.parquet(f"{folder}/labels.parquet")).rules
    assert rules
    expected = collections.Counter()
    for (i, t), n in pairs(d).items():
        counts = dict(zip(quality_rules.COUNTS, brute_counts(t), strict=False))
        chars = [c for w in WORD.findall(t or "") for c in w]
        counts |= {"n_upper": sum("A" <= c <= "Z" for c in chars), "n_digits": sum("0" <= c <= "9" for c in chars), "n_marks": sum(c in ".,;:!?" for c in chars), "n_lines": sum(bool(WORD.search(x)) for x in (t or "").split("\n"))}
        value = lambda name, c=counts: float(c[quality_rules.RATIOS[name][0]]) if quality_rules.RATIOS[name][1] is None else c[quality_rules.RATIOS[name][0]] / c[quality_rules.RATIOS[name][1]] if c[quality_rules.RATIOS[name][1]] else 0.0
        bad = counts["n_words"] < 20 or 100 * counts["n_repeat_words"] > 30 * counts["n_words"] or any(all(value(n) <= x if op == "<=" else value(n) > x for n, op, x in rule.conditions) for rule in rules)
        if not bad:
            expected[(i, t)] = n
    assert got == expected and not any(60 <= i < 90 for i, _ in got if i is not None)


def plain_lines(texts):
    """The texts without recurring lines, by loops over sets of documents."""
    texts = sorted({t for t in texts if t is not None})
    spaced = lambda x: [t for t in re.split("[ \t\x0b\f\r]+", x) if t]
    masked = lambda x: [line_templates.VARIABLE if re.search("[0-9]", t) else t for t in spaced(x)]
    lines = {t: [x for x in t.split("\n") if spaced(x)] for t in texts}
    among = collections.defaultdict(set)
    leaf_docs, leaf_tokens = collections.defaultdict(set), collections.defaultdict(set)
    for t, ls in lines.items():
        for x in ls:
            among[x].add(t)
            leaf = (len(masked(x)), *masked(x)[: line_templates.DEPTH])
            leaf_docs[leaf].add(t)
            for k, tok in enumerate(masked(x)):
                if k >= line_templates.DEPTH:
                    leaf_tokens[(leaf, k)].add(tok)

    def shapes(x):
        toks = masked(x)
        leaf = (len(toks), *toks[: line_templates.DEPTH])
        if len(leaf_docs[leaf]) < line_templates.MIN_DOCS:
            return set()
        loose = [line_templates.VARIABLE if k >= line_templates.DEPTH and len(leaf_tokens[(leaf, k)]) > line_templates.MAX_CHILDREN else y for k, y in enumerate(toks)]
        return {" ".join(c) for c in (toks, loose) if 2 * sum(y != line_templates.VARIABLE for y in c) >= len(c)}

    def carrier(t, x, order):
        ls = set(lines[t])
        shared = sorted((y for y in ls if len(among[y]) > 1), key=order)
        others = [y for y in shared if y != x]
        if 2 * len(others) < len(ls) - 1 or len(ls) == 1:
            return t
        return others[0] if others else t

    return lines, among, shapes, carrier


def test_lines(spark, sf):
    folder, d = sf
    out = keeps_columns("lines", spark, d, folder)
    rows = d.select("doc_id", "text").collect()
    lines, among, shapes, carrier = plain_lines([x.text for x in rows])
    every = sorted({x for ls in lines.values() for x in ls})
    hashes = {x.v: x.h for x in spark.createDataFrame([(x,) for x in every], "v string").select("v", F.xxhash64("v").alias("h")).collect()}
    carriers = collections.defaultdict(set)
    for t, ls in lines.items():
        for x in set(ls):
            if len(among[x]) >= line_templates.MIN_DOCS:
                carriers[("literal", x)].add(carrier(t, x, hashes.get))
            for s in shapes(x):
                carriers[("template", s)].add(carrier(t, x, hashes.get))
    often = {k for k, v in carriers.items() if len(v) >= line_templates.MIN_DOCS}
    gone = lambda x: ("literal", x) in often or any(("template", s) in often for s in shapes(x))
    expected = collections.Counter()
    for x in rows:
        if x.text is None:
            expected[(x.doc_id, None)] += 1
            continue
        left = [y for y in x.text.split("\n") if not (WORD.search(y) and gone(y))]
        changed = len(left) < x.text.count("\n") + 1
        if not changed or any(WORD.search(y) for y in left):
            expected[(x.doc_id, "\n".join(left))] += 1
    assert pairs(out) == expected
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
    assert not any("Posted on" in (t or "") or "Page number" in (t or "") for _, t in expected)


def test_near_duplicates(spark, sf):
    folder, d = sf
    got = pairs(keeps_columns("near_duplicates", spark, d, folder))
    rows = [tuple(x) for x in d.select("doc_id", "text", F.xxhash64("text")).collect()]
    named = sorted((x for x in rows if x[0] is not None), key=lambda x: x[0])
    label = brute_components([t for _, t, _ in named], 5, 80, 100)
    least = {}
    for k in range(len(named)):  # links of rows that repeat an id count for the id
        for j in range(len(named)):
            if named[j][0] == named[k][0] or label[j][1] == label[k][1]:
                least[k] = min(least.get(k, named[k][0]), named[label[j][1]][0])
    expected = collections.Counter()
    for i in {x[0] for x in named}:
        mine = [k for k, x in enumerate(named) if x[0] == i]
        if any(least[k] == i for k in mine):
            expected[(i, min((named[k] for k in mine), key=lambda x: x[2])[1])] += 1
    expected.update((i, t) for i, t, _ in rows if i is None)
    assert got == expected
    assert sum(100 <= i < 112 for i, _ in got if i is not None) == 1


def test_decontaminate(spark, sf):
    folder, d = sf
    got = pairs(keeps_columns("decontaminate", spark, d, folder))
    clean = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
    items = [clean.findall(lower(x.text or "")) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaks(t):
        w = clean.findall(lower(t or ""))
        return any((0 < len(it) < 12 and any(w[k : k + len(it)] == it for k in range(len(w)))) or any(sum(x == y for x, y in zip(w[a : a + 12], it[b : b + 12], strict=True)) >= 10 for b in range(len(it) - 11) for a in range(len(w) - 11)) for it in items)

    bad = {i for (i, t) in pairs(d) if i is not None and leaks(t)}
    assert got == collections.Counter({(i, t): n for (i, t), n in pairs(d).items() if i not in bad}) and {121, 122} <= bad


def test_tokens(spark, sf):
    folder, d = sf
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = STAGES["tokens"](spark, d, folder)
    got = collections.Counter((x.doc_id, tuple(x.token_ids)) for x in out.collect())
    assert got == collections.Counter((i, tuple(sp.encode(t or ""))) for (i, t), n in pairs(d).items() for _ in range(n))
    assert STAGES["tokens"](spark, d.limit(0), folder).count() == 0


def test_run(spark, sf):
    folder, _ = sf
    out = corpus_pipeline.run(spark, folder)
    kept = {x.doc_id for x in out.select("doc_id").collect()}
    assert 100 in kept and not kept & {*range(60, 90), *range(101, 112), 120, 121, 122, 125, 126, 127}
