"""Readers on files that are not as they should be; ranges, dates, comment snapshots, repair plans."""

from __future__ import annotations

import datetime
import random
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import joins, review
from lodestone.sources import files

GOOD = ['{"id": 1, "t": "a\'b"}', ' {"id": 2}\t', '{"id": 3, "t": "x } ] \\" {"}', '{"t": null}', '{"id": "4"}', "{}"]
BAD = ["[1]", '[{"id": 5}, {"id": 6}]', '{"id": 7} junk', '{"id": 8}{"id": 9}', '{"id": 8},{"id": 9}', '{"id": 1}] x', '{"id": 1}} {', "7", "null", '"s"', '{"id": ', "{'id': 1}", "nonsense"]


@pytest.fixture
def lines_file(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join([GOOD[0], "", *BAD, "  \t", *GOOD[1:]]) + "\n", encoding="utf-8")
    return str(p)


def test_json_lines(spark, lines_file):
    kept = files.jsonl(spark, lines_file, "id long, t string", "permissive").collect()
    assert len(kept) == len(GOOD) and [x.id for x in kept][:3] == [1, 2, 3] and kept[0].t == "a'b" and kept[2].t == 'x } ] " {'
    counted = files.jsonl(spark, lines_file, "id long, t string", "counted")
    assert sorted(x[files.BROKEN] for x in counted.where(F.col(files.BROKEN).isNotNull()).collect()) == sorted(BAD)
    with pytest.raises(Exception, match="not a JSON object"):
        files.jsonl(spark, lines_file, "id long").collect()
    with pytest.raises(Exception, match="not a JSON object"):
        files.jsonl(spark, lines_file, "id long").count()
    objects, findings = files.jsonl_findings(spark, lines_file, "id long")
    assert {x._line for x in objects.collect()} == {1, *range(len(BAD) + 4, len(BAD) + 9)}
    got = {x.line_no: x.problem for x in findings.collect()}
    assert got == {k + 3: "not an object" if b in ("[1]", '[{"id": 5}, {"id": 6}]', "7", "null", '"s"') else "invalid JSON" for k, b in enumerate(BAD)}
    assert {x._line for x in files.numbered_jsonl(spark, lines_file, "id long").collect()} == {1, *range(len(BAD) + 4, len(BAD) + 9)}


def test_strict_reads_what_is_whole(spark, tmp_path):
    (tmp_path / "y.jsonl").write_text("\n".join(["", *GOOD, " "]))
    assert files.jsonl(spark, str(tmp_path / "y.jsonl"), "id long").count() == len(GOOD)
    (tmp_path / "z.jsonl").write_text("")
    assert files.jsonl(spark, str(tmp_path / "z.jsonl"), "id long").count() == 0


def test_cards(spark, tmp_path):
    top = tmp_path / ".work" / "cards"
    (top / "sub").mkdir(parents=True)
    (top / ".hidden").mkdir()
    (top / "a.md").write_text('---\ntitle: first\nid: 7\ntitle: "last: one"\n---\nBody\n---\n')
    (top / "sub" / "b.md").write_text("﻿---\nid: 8\n---\n")
    (top / "sub" / ".c.md").write_text("---\nid: 9\n---\n")
    (top / ".hidden" / "d.md").write_text("x")
    (top / "e.md").write_text("no head")
    got = {x.path.rsplit("/", 1)[1]: (x.meta, x.body) for x in files.cards(spark, str(top)).collect()}
    assert got == {"a.md": ({"id": "7", "title": "last: one"}, "Body\n---\n"), "b.md": ({"id": "8"}, ""), "e.md": ({}, "no head")}


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes('﻿id,t,tags\n1,"two\nlines","a; b"\n2,"say ""x"", y",\n'.encode())
    got = sorted((x.id, x.t, x.tags) for x in files.records_by_suffix(spark, str(p), "", "old").collect())
    assert got == [("1", "two\nlines", ["old", "a", "b"]), ("2", 'say "x", y', ["old"])]


@pytest.mark.parametrize("most", [10_000, 0])
def test_ranges_keep_every_row(spark, most):
    r = random.Random(2)
    ranges = [(a, a + r.choice([0, 1, 7, 40]), f"r{k}") for k, a in enumerate(r.sample(range(-100, 100), 30))] + [(None, 5, "open"), (3, None, "open")]
    values = [(k, r.choice([None, *range(-130, 150)])) for k in range(300)]
    d, s = spark.createDataFrame(values, "k int, v int"), spark.createDataFrame(ranges, "a int, b int, name string")
    got = sorted((x.k, x.name or "") for x in joins.within_ranges(d, s, F.col("v"), "a", "b", most).collect())
    expected = []
    for k, v in values:
        hits = [n for a, b, n in ranges if None not in (v, a, b) and a <= v < b]
        expected += [(k, n) for n in hits or [""]]
    assert got == sorted(expected)
    one = spark.createDataFrame([(1, 3, "x")], "a int, b int, name string")
    assert joins.within_ranges(d, one, F.col("v"), "a", "b", most).count() == len(values)


def plain_date(raw):
    """The forms in their order; the last two by the standard library."""
    import re

    m = re.search(r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b", raw)
    if m:
        try:
            return datetime.date(*map(int, m.groups())).isoformat()
        except ValueError:
            return ""
    m = re.search(r"\b(20\d{2})\s+([A-Za-z]{3,9})\s+(\d{1,2})\b", raw)
    for form in ("%Y %b %d", "%Y %B %d") if m else ():
        try:
            return datetime.datetime.strptime(" ".join(m.groups()), form).date().isoformat()
        except ValueError:
            pass
    try:
        return parsedate_to_datetime(raw).date().isoformat()
    except (TypeError, ValueError):
        pass
    try:
        return datetime.datetime.fromisoformat(raw).date().isoformat()
    except ValueError:
        return ""


def test_dates(spark):
    raw = ["2024 Marble 7", "2024 Sept 5", "20240307", "2024 march 7", "2024 DEC 31", "on 2024/3/7, late", "2024-02-30", "2024 Feb 30", "Thu, 7 Mar 2024 10:00:00 +0000", "7 March 2024 10:00:00", "7 Marsh 2024 10:00:00", "1999-03-07", "2024-03-07T10:00:00Z", "20240307T101500", "soon", "", "2024 May 1", "x2024-03-07"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, x string").select("k", fx.normalise_date("x").alias("d")).collect()
    assert {raw[x.k]: x.d for x in got} == {x: plain_date(x) for x in raw}


def test_comment_delta(spark):
    r = random.Random(4)

    def snapshot():
        return {k: (r.choice("ab"), r.choice([True, False]), r.choice(["active", "withdrawn", None]), r.choice(["open", "withdrawn", None]), r.choice([1, 2])) for k in range(120) if r.random() < 0.8}

    before, after = snapshot(), snapshot()
    expected = set()
    for k in before.keys() | after.keys():
        b, a = before.get(k), after.get(k)
        if b is None or a is None:
            expected.add((k, "added" if b is None else "withdrawn"))
            continue
        bw, aw = "withdrawn" in b, "withdrawn" in a
        if bw != aw:
            expected.add((k, "withdrawn" if aw else "restored"))
        if a[:2] != b[:2] or (a[2:4] != b[2:4] and bw == aw):
            expected.add((k, "edited"))
        if a[4] != b[4]:
            expected.add((k, "replied"))
    schema = "k int, content_hash string, human_edited boolean, lifecycle_state string, finding_state string, replies int"
    d = [spark.createDataFrame([(k, *v) for k, v in s.items()], schema) for s in (before, after)]
    got = review.comment_delta(*d, "k").collect()
    assert {(x.k, x.change) for x in got} == expected and len(got) == len(expected)
    assert {c for _, c in expected} == {"added", "edited", "withdrawn", "restored", "replied"}


def test_preflight(spark):
    items = [(1, "a", "text", None, 1), (1, "b", "text", [], 2), (2, "c", "text", None, 3), (2, "d", "table", ["late", "x"], 4), (2, "e", "table", ["x"], 5), (3, "f", None, ["late"], 6), (4, "g", None, None, 7), (4, "h", "text", None, 8)]
    d = spark.createDataFrame(items, "page int, key string, family string, blocked array<string>, at int")
    plans = review.preflight(d, "page", "key", "family", "blocked", "at")
    got = {x.page: (x.family, x["keys"], x.source_count, x.status, x.blocked_reasons) for x in plans.collect()}
    assert got[1] == ("text", ["a", "b"], 2, "ready", [])
    assert got[2] == (None, ["c", "d", "e"], 3, "blocked", ["late", "x", "families that do not go together: table, text"])
    assert got[3] == ("", ["f"], 1, "blocked", ["late"]) and got[4][3] == "blocked"
    assert tuple(review.preflight_totals(plans).first()) == (1, 3, True)
    assert tuple(review.preflight_totals(plans, 0).first()) == (1, 3, False)
