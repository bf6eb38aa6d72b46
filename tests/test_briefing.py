"""The briefing, its health and payloads against plain loops."""

from __future__ import annotations

import itertools
import json
import random
from pathlib import Path

from lodestone.operators import briefing

ITEMS = "item_id string, source_id string, title string, url string, published_at string, summary string, tags array<string>, event_type string, topic_relevance double, method_novelty_hint double, reading_tier string, freshness_gate string, secret string"


def some_items(n):
    rng = random.Random(2)
    return [
        (f"i{k}", rng.choice(["s", None]), rng.choice(["A  title", "b", "é"]) + str(k % 7), rng.choice(["", None, "https://x.example/a"]), rng.choice([None, "", "2024-03-07"]), rng.choice([None, " some\nwords "]), rng.choice([None, ["t"]]), "new",
         rng.choice([None, 0.25, 1.0, 0.0001, 0.0]), rng.choice([0.5, None]), rng.choice(["must_read", "skim", "archive", "other", None]), "fresh", "x") for k in range(n)
    ]


def plain_markdown(rows, status, loaded, sources):
    text = lambda v: " ".join((v or "").split())
    out = ["# Brief · 2024-06-30", "", f"> Daily status: **{status}** · sources {loaded}/{sources} · items {len(rows)}", "", briefing.NOTICE, ""]
    number = lambda v: "None" if v is None else f"{v:.4f}".rstrip("0") + ("0" if v == int(v) else "")
    for tier, label in briefing.TIERS.items():
        here = sorted((r for r in rows if r[10] == tier), key=lambda r: (-(r[8] or 0), text(r[4]), text(r[2]).lower(), r[0]))
        out += [f"## {label} · {len(here)}", ""] + ([] if here else ["No items.", ""])
        for r in here:
            out += [f"### [{text(r[2])}]({r[3]})" if r[3] else f"### {text(r[2])}", "", f"- Source: `{text(r[1])}` · published `{text(r[4]) or 'undated'}` · freshness `{r[11]}`"]
            out += [f"- Topic relevance: `{number(r[8])}` · novelty hint: `{number(r[9])}`", f"- Event: `{r[7]}` · identity: `{r[0]}`", "", text(r[5]) or "No summary supplied by the source.", ""]
    return "\n".join([*out, "---", "", briefing.CLOSING, ""])


def test_markdown(spark, tmp_path):
    health = spark.createDataFrame([("complete", 3, 2)], "daily_status string, source_count long, loaded_source_count long")
    for n in (0, 60):
        rows = some_items(n)
        briefing.write_markdown(briefing.markdown(spark.createDataFrame(rows, ITEMS), health, "2024-06-30"), str(tmp_path / str(n)))
        assert "".join(p.read_text() for p in sorted(Path(tmp_path / str(n)).glob("part-*"))) == plain_markdown(rows, "complete", 2, 3)


def test_items_and_order(spark):
    df = spark.createDataFrame(some_items(40), ITEMS)
    public = briefing.public_items(df)
    assert public.columns == briefing.PUBLIC and "secret" not in public.columns
    ranks = [{**dict.fromkeys([None, "other"], 9), **{t: k for k, t in enumerate(briefing.TIERS)}}[r.reading_tier] for r in public.orderBy(*briefing.reading_order()).collect()]
    assert ranks == sorted(ranks)
    assert {r.candidate_id for r in briefing.content_candidates(df, "d").collect()} == {f"content:{r[0]}" for r in some_items(40) if r[10] in ("must_read", "skim")}
    assert all(len(r.title) <= 300 and r.tags is not None for r in briefing.compact_items(df).collect())


def plain_status(sources):
    on = [s for s in sources if s[0]]
    need = [s for s in on if s[1]]
    down, bad = [s for s in on if s[2] in ("failed", "missing")], [s for s in need if s[2] in ("failed", "missing")]
    warned = any(s[2] in ("partial", "warning") or (not s[1] and s[2] in ("failed", "missing")) for s in on)
    if not need:
        return "failed" if on and len(down) == len(on) else "complete_with_warning" if warned else "complete"
    if bad:
        return "failed" if len(bad) == len(need) else "degraded"
    return "complete_with_warning" if warned else "complete" if any(s[2] in briefing.LOADED for s in need) else "degraded"


def test_health(spark):
    kinds = list(itertools.product([True, None], [True, False], ["ok", "failed", "partial", "inactive"]))
    for case in [[], *([k] for k in kinds[::3]), *(random.Random(k).sample(kinds, 3) for k in range(8))]:
        got = briefing.run_health(spark.createDataFrame(case, "enabled boolean, required boolean, status string")).first()
        assert tuple(got) == (plain_status(case), sum(bool(s[0]) for s in case), sum(s[2] == "ok" for s in case))


def test_manifests_and_payloads(spark):
    sources = spark.createDataFrame([("a", "k", True, None, " ", "ok", None), ("b", None, None, True, "main", "failed", " no \n answer ")], "source_id string, source_kind string, enabled boolean, required boolean, role string, status string, error string")
    got = briefing.source_manifests(sources, spark.createDataFrame([("a",), ("a",), ("z",)], "source_id string"), "t").orderBy("source_id").collect()
    assert [tuple(r) for r in got] == [("a", "k", True, False, "supplemental", "ok", 2, "", "t"), ("b", "", False, True, "main", "failed", 0, "no answer", "t")]
    rows = [(k, f"x{k}" if k % 3 else None) for k in range(23)]
    made = briefing.batch_payloads(spark.createDataFrame(rows, "k int, x string"), ["k"], ["x", "gone", "k"], 10).orderBy("batch").collect()
    assert [json.loads(r.payload) for r in made] == [{"fields": ["x", "gone", "k"], "rows": [[x, None, str(k)] for k, x in rows[b : b + 10]]} for b in (0, 10, 20)]
