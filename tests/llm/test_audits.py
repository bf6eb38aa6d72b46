"""Filter audit, structure repair and source mix against plain versions on small tables with nulls,
empty texts, repeated rows, ties and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from lodestone.llm import filter_audit, source_mix, turn_repair
from lodestone.llm.queries import oracle_sql, queries
from tests.oracle import connection, difference

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_turn_repair"])
def test_equals_sql(spark, name):
    assert difference(queries()[name](spark, SF), connection(SF), oracle_sql()[name]) == ""


# Filter audit


def audited(rows, labels):
    """(part, order, step) -> figures, by playing each order on each document."""
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    failed = []
    for i, text, lang, *_ in rows:
        t = text or ""
        words = WORD.findall(t)
        low = min((j for j, u, *_ in rows if (u or "") == t and j is not None), default=None)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > low}
        failed.append((lang or "", {f for f, x in tests.items() if x}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        removals = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                row = Counter()
                for p, fails, g, t in failed:
                    if p != part:
                        continue
                    gone, hit = bool(fails & set(order[: step - 1])), f in fails
                    row += Counter(kept=not hit and not gone, removed=hit and not gone, redundant=hit and gone, unique_fails=fails == {f}, good_lost=hit and not gone and g, toxic_lost=hit and not gone and t)
                removals[f] += row["removed"]
                out[part, order, step] = row
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = removals[order[step - 1]]
    return out


def test_filter_audit(spark):
    r = random.Random(4)
    texts = [None, "", " \t\n", "A" * 50, "one #tag", " x y", "Über UND wir", "x" * 30000]
    texts += [" ".join(r.choice(["a", "b", "The", "&", "c1", "日本", "d"]) + str(r.randrange(1 + 300 * (k % 2))) for _ in range(r.randint(150, 260))) for k in range(6)]
    rows = [(k if k % 7 else None, r.choice(texts), r.choice(["en", "de", None, ""]), 1, "m", "n") for k in range(60)] + [(3, "one #tag", "en", 1, "m", "n")] * 2
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for k in range(-5, 50)] + [(3, 1, 1, "x"), (None, 1, 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, mask string, part string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.audit(d, lab).collect()
    expected = audited(rows, labels)
    assert len(got) == len(expected) == 3 * 600
    for x in got:
        row = expected[x.part, x.filter_order, x.step]
        assert {k: x[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == {k: row[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert {x.good_lost for x in filter_audit.audit(d, lab.limit(0)).collect()} == {0}


# Structure repair


def rows_after(rows):
    out = []
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit:
            row = (c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            out += [row, row] if hit == 3 else [row]
    return out


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        last = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, rows) by trying every edit at every row, with a table of what is left to do."""
    found = faults(turns)

    @lru_cache(None)
    def best(i, said, put):
        options = []
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", said):
            return 0, "", ()
        # what was said matters only by its last two initials
        if put < 2:
            for role in ("user", "assistant"):
                if re.fullmatch("(s?(ua)*u?)", said + role[0]):
                    c, a, rest = best(i, short(said + role[0]), put + 1)
                    options.append((c + 3, "I" + a, (f"{role}:", *rest)))
        if i < len(turns):
            c, a, rest = best(i + 1, said, 0)
            options.append((c + 4, "D" + a, rest))
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                for edit, role, cost in (("K", turns[i][0], 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if role and re.fullmatch("s?(ua)*u?", said + role[0]):
                        c, a, rest = best(i + 1, short(said + role[0]), 0)
                        options.append((c + cost + more, edit + a, (f"{role}:{turns[i][1]}", *rest)))
        return min(options, default=(10**9, "", ()))

    def short(said):
        while said.endswith("uaua"):
            said = said[:-2]
        return said[:1] + "uaua"[: 2 + len(said[1:]) % 2] if said[:1] == "s" and len(said) > 4 else said

    return best(0, "", 0)


def repairs(rows, damage=True):
    left, out = rows_after(rows) if damage else [(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows], {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[2:4] for r in mine]
        numbers, found = [r[1] for r in mine if r[1] is not None], Counter(faults(turns))
        cost, audit, rest = cheapest(tuple(turns))
        out[c] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, found["blank"], found["duplicate"], found["truncated"], sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit, hashlib.sha256("\n".join(rest).encode()).hexdigest())
    return out


def some_turns(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for c in [*range(conversations), None]:
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.5 else ("user", "assistant")[t % 2]
            text = r.choice(["Yes.", "No!", "so what", " \n", "", None, "Why? ", f"{t} is it.", f"{t}\x0b", "ö."])
            rows.append((c, r.choice([t, t, t, t + 3, None]), role, text, "k", 5))
    return rows


def plain(df):
    return {x.conv_id: tuple(x[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for x in df.collect()}


SCHEMA = "conv_id long, turn int, role string, text string, key string, part int"


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"long_rows": 3, "segment": 2}), (3, {"long_rows": 1, "segment": 3}), (4, {"long_bytes": 12, "segment": 1})])
def test_repair_is_the_cheapest(spark, seed, limits):
    rows = some_turns(seed, 60, 9)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert plain(turn_repair.repair(turn_repair.damaged(d), d, **limits)) == repairs(rows)
    assert plain(turn_repair.repair(d, d, **limits)) == repairs(rows, damage=False)


def test_one_long_conversation(spark):
    rows = [(7, t, ("user", "assistant", "assistant")[t % 3], f"{t % 900} said{'.' * (t % 4 > 0)}", "k", 5) for t in range(1500)] + [(8, 0, "system", "S.", "k", 5)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = plain(turn_repair.repair(d, d))
    assert whole == plain(turn_repair.repair(d, d, long_rows=100, segment=64))
    assert whole[8] == (0, 0, 0, 0, 0, 4, "D", hashlib.sha256(b"").hexdigest())


def test_conversations_without_rows(spark):
    d = spark.createDataFrame([(1, None, None, None, "k", 5)], SCHEMA)
    assert plain(turn_repair.repair(d.limit(0), d)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert turn_repair.repair(d.limit(0), d.limit(0)).count() == 0


# Source mix


def goals(totals, weights=(1, 2, 3), most=3):
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(totals.values()) - sum(most * totals[s] for s in full)
        level = left / sum(w for s, w in weight.items() if s not in full) if len(full) < len(names) else 0
        above = {s for s in names if s not in full and weight[s] * level >= most * totals[s]}
        if not above:
            return {s: most * totals[s] if s in full else weight[s] * level for s in names}
        full |= above


def mixed(df):
    return sorted((x.doc_id if x.doc_id is not None else -1, x["size"], x.source_size, x.target, x.taken) for x in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    r = random.Random(seed)
    rows = [(k, " ".join("w" for _ in range(int(r.paretovariate(0.8)) % 3000)), r.choice(["a", "b", "b", "b", "b", "é", "z", "日", None]), 1, "n") for k in range(400)]
    rows += [(k, None, "a", 1, "n") for k in range(400, 403)] + [(403, "", "empty", 1, "n"), (404, "two words", "tiny", 1, "n"), (404, "two words", "tiny", 1, "n"), (None, "one", "b", 1, "n"), (None, "one", "b", 1, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, bucket string").repartition(3)
    names = d.selectExpr("doc_id AS other", "coalesce(source, '~') AS name").distinct()
    made = source_mix.mix(d, bucket=5)
    got = made.join(names, made.doc_id.eqNullSafe(names.other)).collect()
    totals = Counter()
    for _, t, s, *_ in rows:
        totals[s] += len(WORD.findall(t or ""))
    expected, taken, smallest = goals(totals), Counter(), {}
    for x in got:
        s = None if x.name == "~" else x.name
        assert x.source_size == totals[s] and x.target == pytest.approx(expected[s]) and x.taken in {k * x["size"] for k in range(4)}
        taken[s] += x.taken
        if x["size"]:
            smallest[s] = min(smallest.get(s, 10**9), x["size"])
    for s in totals:
        assert abs(taken[s] - expected[s]) <= max(1, smallest.get(s, 0)), (s, taken[s], expected[s])
    one = mixed(source_mix.mix(d, bucket=5))
    assert len(one) == len(rows) and one == mixed(source_mix.mix(d.repartition(7), bucket=5))


def test_rates_solve_the_dual(spark):
    """Largest entropy: the multiplier of each source gives its target, and rates are tilted by size."""
    import math

    sizes = [("=a", s, n) for s, n in ((1, 50), (5, 20), (40, 9), (900, 1))] + [("=b", s, n) for s, n in ((3, 10), (7, 4), (300, 2))]
    total = Counter()
    for s, size, n in sizes:
        total[s] += size * n
    want = {"=a": total["=a"] * 0.31, "=b": total["=b"] * 2.6}
    d = spark.createDataFrame(sizes, "source string, size long, n long")
    g = spark.createDataFrame([(s, total[s], want[s]) for s in total], "source string, total long, target double")
    for x in source_mix.multipliers(d, g).collect():
        got = sum(n * size * min(3, math.exp(x.multiplier * size / x["mean"])) for s, size, n in sizes if s == x.source)
        assert got == pytest.approx(want[x.source], rel=1e-5, abs=0.01)


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert mixed(source_mix.mix(d)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixed(source_mix.mix(d.limit(0))) == []


def test_copies_of_one_size_share_evenly(spark):
    rows = [(k, "same words here", "hot") for k in range(300)] + [(k, "x " * 40, "b") for k in range(300, 310)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    made = source_mix.mix(d, bucket=16).where("source_size = 900").selectExpr("sum(taken)", "max(target)", "max(copies) - min(copies)").first()
    assert abs(made[0] - made[1]) <= 3 and made[2] == 1
