"""Faults of pages against a plain loop."""

from __future__ import annotations

import random
import re

from lodestone.operators import layout


def covered(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    return w * h / max(1.0, min(area(a), area(b))) if w > 0 and h > 0 else 0.0


def plain(page, lines, frame, median):
    """Faults of one page's lines (n, text, size, box)."""
    cjk = lambda t: len(re.findall("[㐀-鿿]", t))
    latin = lambda t: len(re.findall("[A-Za-z]", t))
    bare = lambda t: re.sub(r"\s", "", t)
    letters = lambda t: re.sub("[^0-9A-Za-z㐀-鿿]", "", t).lower()
    union = lambda boxes: tuple((min, min, max, max)[k](b[k] for b in boxes) for k in range(4))
    single = lambda t: cjk(t) == 1 and len(bare(t)) <= 2
    out = []
    rows = [(n, " ".join((t or "").split()), s, b) for n, t, s, b in sorted(lines, key=lambda r: (r[3][1], r[3][0], r[0]))]
    for k, (_, t, s, b) in enumerate(rows):
        if b[0] < frame[0] - 0.5 or b[1] < frame[1] - 0.5 or b[2] > frame[2] + 0.5 or b[3] > frame[3] + 0.5:
            out.append((page, "clipped", f"outside: {t[:80]}", *b))
        lone = len(bare(t)) == 1 and letters(t) and not letters(t).isdigit() and b[0] > (frame[2] - frame[0]) * 0.72 and s >= 6.5
        if lone or single(t) and (b[2] >= frame[2] - 2 or b[0] <= frame[0] + 2):
            out.append((page, "clipped", f"fragment: {t[:20]}", *b))
        for _, u, z, c in rows[k + 1 : k + 10]:
            if c[1] > b[3] + 3:
                break
            mixed = cjk(t) and (cjk(u) or latin(u) >= 2) or cjk(u) and latin(t) >= 2
            share, x, y = covered(b, c), *sorted((letters(t), letters(u)), key=len)
            twice = x and (x == y or len(x) >= 6 and x in y)
            beside = abs((b[1] + b[3]) / 2 - (c[1] + c[3]) / 2) <= 2 and share < 0.82
            if mixed and share >= 0.65 and not twice and not beside and len(x) <= 12 and max(s, z) >= max(11.5, median * 1.15):
                out.append((page, "overlap", f"{t[:40]} / {u[:40]}", *union([b, c])))
                break
    ones = [r for r in rows if single(r[1])]
    for k in range(len(ones)):
        members = [ones[k]]
        for r in ones[k + 1 : k + 8]:
            p, b = members[-1][3], r[3]
            if abs((b[0] + b[2]) / 2 - (p[0] + p[2]) / 2) > max(5, (p[2] - p[0]) * 1.4) or not 0 <= b[1] - p[3] <= max(16, (p[3] - p[1]) * 2.2):
                break
            members.append(r)
        if len(members) >= 3:
            out.append((page, "stack", "".join(r[1] for r in members), *union([r[3] for r in members])))
            break
    return out


SCHEMA = "page string, n int, words string, size double, x0 double, y0 double, x1 double, y1 double, px0 double, py0 double, px1 double, py1 double, median double"


def test_issues_equal_a_plain_loop(spark):
    rng = random.Random(3)
    frame, pages, rows = (0.0, 0.0, 200.0, 900.0), {}, []
    for page in [*map(str, range(12)), None]:
        lines, y, stacked = [], 0.0, page in ("1", "4", "7", None)
        for n in range(rng.choice([1, 5, 40, 90])):
            y += rng.choice([0, 0, 1, 4, 12, 30])
            x, w, h = rng.choice([-1.0, 1.0, 50.0, 52.0, 150.0, 196.0]), rng.choice([3.0, 8.0, 60.0]), rng.choice([3.0, 8.0, 12.0])
            words = rng.choice(["中", "中 ", "文。", "表格数据", "Table", "A", "7", "table 1", "the data 数", "a long line of Latin words", "", None, "数据 the data 数"])
            if stacked and rng.random() < 0.8:
                x, words = rng.choice([50.0, 52.0]), rng.choice(["中", "文。"])
            lines.append((n, words, rng.choice([5.0, 9.0, 12.0, 14.0]), (x, y, x + w, y + h)))
        pages[page] = lines
        rows += [(page, n, t, s, *b, *frame, 10.0) for n, t, s, b in lines]
    rng.shuffle(rows)
    expected = sorted((x for p, lines in pages.items() for x in plain(p, lines, frame, 10.0)), key=repr)
    assert {x[1] for x in expected} == {"clipped", "overlap", "stack"}
    df = spark.createDataFrame(rows, SCHEMA)
    for segment in (10, 4096):
        got = layout.layout_issues(df, "page", "words", "size", ("px0", "py0", "px1", "py1"), "median", ["n"], segment).collect()
        assert sorted(map(tuple, got), key=repr) == expected


def test_no_lines(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert layout.layout_issues(df, "page", "words", "size", ("px0", "py0", "px1", "py1"), "median", ["n"]).count() == 0


def test_lines_are_dealt_before_what_is_derived(spark):
    """What a line is compared by was shuffled beside the columns that it is made of."""
    df = spark.createDataFrame([("p", 1, "Table", 9.0, *[1.0] * 8, 10.0)], SCHEMA)
    made = layout.layout_issues(df, "page", "words", "size", ("px0", "py0", "px1", "py1"), "median", ["n"])
    assert "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString()
