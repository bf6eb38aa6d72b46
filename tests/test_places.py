"""Matching of expected events and joins of boxes against plain loops."""

from __future__ import annotations

import random
import re
import time

import pytest

from lodestone.operators import matching, spatial

CANDIDATE = "candidate_id string, title string, event_type string, basis string, boundary_status string, date string"
EXPECTED = "gold_id string, place long, title_regex string, event_type string, basis string, date string"


def fits(c, e):
    return (not e[2] or re.search(e[2], c[1] or "") is not None) and (not e[3] or c[2] == e[3]) and (not e[4] or c[3] == e[4])


def greedy(candidates, expected):
    used, out = set(), {}
    for e in sorted(expected, key=lambda e: e[1]):
        left = [c for c in candidates if c[0] not in used and fits(c, e)]
        won = left[0] if len(left) == 1 else None
        if won:
            used.add(won[0])
        due = e[5]
        out[e[0]] = (won is not None, won and won[0], len(left), "not_scored" if not due else "unknown" if not won or won[5] is None else "exact" if won[5] == due else "mismatch")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_are_those_of_a_plain_loop(spark, seed):
    r = random.Random(seed)
    candidates = [(f"c{k}", r.choice(["red ring", "blue (x)", "", None, "ring 7"]), r.choice(["a", "b", None, ""]), r.choice(["x", "y", None]), r.choice(["open", "shut", None]), r.choice(["1", "2", None])) for k in range(25)]
    expected = [(f"g{k}", k * 3, r.choice(["^red", "ring", r"\(x\)", "", None, "7$"]), r.choice(["a", "b", "", None]), r.choice(["x", "y", None]), r.choice(["1", "", None])) for k in range(40)]
    c, e = spark.createDataFrame(candidates, CANDIDATE).repartition(3), spark.createDataFrame(expected, EXPECTED).repartition(3)
    made = matching.matched(c, e)
    want = greedy(candidates, expected)
    assert {x.gold_id: (x.matched, x.candidate_id, x.match_count, x.date_status) for x in made.collect()} == want
    assert {x.candidate_id for x in matching.unmatched(c, made).collect()} == {x[0] for x in candidates} - {w[1] for w in want.values()}
    got = matching.recall(made).first()
    due = [w for w in want.values() if w[3] != "not_scored"]
    assert (got.expected_events, got.matched_events, got.expected_dates, got.exact_dates) == (40, sum(w[0] for w in want.values()), len(due), sum(w[3] == "exact" for w in due))
    cases = spark.createDataFrame([(x[0], *x[2:5], r.choice(["open", None])) for x in expected], "case_id string, title_regex string, event_type string, basis string, boundary_status string")
    for x in matching.review_cases(c, cases).join(cases, "case_id").collect():
        n = sum(fits(y, (0, 0, x.title_regex, x.event_type, x.basis)) and y[4] == x.boundary_status for y in candidates)
        assert (x.match_count, x.matched) == (n, n == 1)


def test_a_chain_of_events_decides_in_order(spark):
    """g0 has c0 only; each later one shares a candidate with the one before."""
    candidates = [(f"c{k}", f" {k} {k + 1} ", "a", "x", None, None) for k in range(6)]
    expected = [(f"g{k}", k, f" {k} ", None, None, None) for k in range(6)]
    c, e = spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(expected, EXPECTED)
    assert {x.gold_id: x.candidate_id for x in matching.matched(c, e).collect()} == {f"g{k}": f"c{k}" for k in range(6)}
    assert [x.matched for x in matching.matched(c.limit(0), e).collect()] == [False] * 6
    assert matching.matched(c, e.limit(0)).count() == 0
    assert matching.recall(matching.matched(c, e.limit(0))).first().anchor_recall == 1.0


SIDES = ("x0", "y0", "x1", "y1")


def some_boxes(r, n, wide):
    out = []
    for k in range(n):
        x, y = r.choice([0, 128, 256, 300, 511, -40]) + r.choice([0.0, 0.5]), float(r.choice([0, 100, 256, 400, -5]))
        out.append((r.choice(["p", "q", None]), k, x, y, x + r.choice(wide), y + r.choice([10.0, 30.0, 256.0, 600.0]), r.choice(["some words", "Page 3 of 9", "12", "", None, "other"])))
    return out + [("p", n, None, 1.0, 2.0, 3.0, "no side")]


BOX = "page string, id int, x0 double, y0 double, x1 double, y1 double, said string"


def test_points_in_boxes(spark):
    r = random.Random(3)
    boxes = some_boxes(r, 30, [20.0, 256.0, 700.0])
    points = [(r.choice(["p", "q", "none"]), k, r.choice([0.0, 128.0, 255.9, 256.0, 300.5, 900.0, -40.0]), r.choice([0.0, 99.9, 256.0, 410.0, 2000.0, -9.0])) for k in range(300)]
    b, p = spark.createDataFrame(boxes, BOX), spark.createDataFrame(points, "page string, pid int, x double, y double").repartition(3)
    got = {x.pid: x.box for x in spatial.assign(p, b.selectExpr("page", "id AS box", "-id AS order", *SIDES), "page", "pid", "x", "y", "box", "order", SIDES).collect()}
    expected = {}
    for page, k, x, y in points:
        mine = sorted((c for c in boxes if c[0] == page and c[3] is not None), key=lambda c: -c[1])
        inside = [c for c in mine if None not in c[2:6] and c[2] <= x < c[4] and c[3] <= y < c[5]]
        if mine:
            expected[k] = (inside or [min(mine, key=lambda c: abs(c[3] - y))])[0][1]
    assert got == expected


def test_companions(spark):
    r = random.Random(8)
    texts, tables = some_boxes(r, 600, [20.0, 120.0, 400.0]), some_boxes(r, 40, [90.0, 300.0])
    t, b = spark.createDataFrame(texts, BOX).repartition(3), spark.createDataFrame(tables, BOX).selectExpr("page", "id AS box", *SIDES)
    got = {(x.page, x.box, x.id, x.position, x.distance) for x in spatial.companions(t, b, "page", "id", "box", "said", SIDES).collect()}
    expected, seen = set(), set()
    for tab in tables:
        for c in texts:
            said = (c[6] or "").strip()
            if tab[0] != c[0] or c[0] is None or None in c[2:6] or None in tab[2:6] or not said or re.fullmatch(r"(?:Page\s+)?\d+(?:\s+of\s+\d+)?", said, re.I):
                continue
            if max(0.0, min(c[4], tab[4]) - max(c[2], tab[2])) / max(1.0, min(c[4] - c[2], tab[4] - tab[2])) < 0.35:
                continue
            position, d = ("above", tab[3] - c[5]) if c[5] <= tab[3] else ("below", c[3] - tab[5]) if c[3] >= tab[5] else (None, 0)
            if position and d <= (72 if position == "above" else 150) and (c[0], *c[2:6], said) not in seen:
                seen.add((c[0], *c[2:6], said))
                expected.add((c[0], tab[1], c[1], position, round(d, 1)))
    assert got == expected and len(got) > 20


def test_many_in_one_place_are_compared_once(spark):
    """60,000 points in 60,000 equal boxes, and as many equal texts under equal tables: their pairs would take minutes."""
    began, n = time.monotonic(), 60_000
    ids = spark.range(n).repartition(3)
    points = ids.selectExpr("'p' AS page", "id AS pid", "double(id % 2) * 20 AS x", "1.0d AS y")
    boxes = ids.selectExpr("'p' AS page", "id AS box", "-id AS order", "0d AS x0", "0d AS y0", "10d AS x1", "10d AS y1")
    made = spatial.assign(points, boxes, "page", "pid", "x", "y", "box", "order", SIDES)
    assert [tuple(x) for x in made.groupBy("box").count().collect()] == [(n - 1, n)]
    texts = ids.selectExpr("'p' AS page", "id + 5 AS id", "if(id % 2 = 0, 'a', 'b') AS said", "0d AS x0", "20d AS y0", "10d AS x1", "25d AS y1")
    got = spatial.companions(texts, boxes, "page", "id", "box", "said", SIDES)
    assert {tuple(x) for x in got.select("box", "id", "position", "distance").collect()} == {(0, 5, "below", 10.0), (0, 6, "below", 10.0)}
    assert time.monotonic() - began < 90


def test_events_that_fit_many_alike_need_no_rounds(spark, monkeypatch):
    """Sixty events that all fit the same alike candidates: a round for each of them before."""
    writes = []
    monkeypatch.setattr(matching, "cut", lambda df, cut=matching.cut: writes.append(1) or cut(df))
    candidates = [(f"c{k}", f"ring {k % 3}", "a", "x", None, None) for k in range(9)] + [("d0", "bolt", "b", "y", None, None), ("d1", "nut", "b", "y", None, None)]
    wanted = lambda k: "bolt" if k % 20 == 7 else "nut|bolt" if k % 20 == 8 else ("ring", "^ring 1", "")[k % 3]
    expected = [(f"g{k:02}", k, wanted(k), None, None, None) for k in range(60)]
    made = matching.matched(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(expected, EXPECTED))
    assert {x.gold_id: (x.matched, x.candidate_id, x.match_count, x.date_status) for x in made.collect()} == greedy(candidates, expected)
    assert len(writes) < 30
