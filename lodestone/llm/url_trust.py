"""URL filters: explicit rules, and trust that flows over the host graph.

A rule is a host and the beginning of a path. It fits its host and all subdomains if the URL's path
begins with the rule's; of the rules that fit, the longest decides. Hosts of pages that rules allow
are trusted seeds, hosts of pages that rules block are distrusted seeds (by their number of pages).

Hosts are joined by edges: links in the pages to other hosts, and both ways between a host and the
domain above it (without the first label), up to a domain of two labels, whether these have pages or
not; so hosts of one owner are near each other even where links do not leave their host. There is no
list of public suffixes: hosts below one of two labels are taken for one owner's. Two personalised PageRanks
run at once: trust from the trusted seeds along the edges, distrust from the blocked seeds against
them (a host that links to bad hosts is suspect). What a host without edges would pass on, and the
restart, return to the seeds. The ranks are iterated until those of all hosts have settled and no
host is reached anew, however long the chains of links are. A host is blocked if its share of all
distrust is more than its share of all trust times `threshold` (if they are equal, it is allowed);
pages that no rule fits get their host's verdict. Without seeds of a kind its shares are zero.

Null URLs and URLs without "://" have an empty host and path; no rule fits them and they are
allowed. Null pages have no links. Repeated rows are judged each by itself. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import drop, settle, tidy

STEPS, DAMPING, THRESHOLD = 10, 0.85, 1.0
#: Steps between two looks, and the largest change of a host's rank over them, as a share of it, that ends;
#: all later steps add about a sixth as much (DAMPING ** ROUND and its powers).
ROUND, SETTLED = 12, 5e-7
#: Steps in one plan. The driver holds a plan and the code made for it; plans of the same form share their code.
PLAN = 3


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_host(pages: DataFrame, url: str) -> DataFrame:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return pages.withColumns({"host": lowered(F.regexp_extract(text, pattern, 1)), "path": F.regexp_extract(text, pattern, 2)})


def by_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the rule that decides, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        name = F.when(r.fits(host, path), F.lit(r.name)).otherwise(name)
        verdict = F.when(r.fits(host, path), F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, w) between different hosts, from pages with the column host."""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), 1)).alias("dst"))
    links = links.select("src", lowered(F.col("dst")).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.where(F.col("host") != "").select("host").distinct()
    labels = F.split("host", r"\.")
    tail = lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels)))
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(tail(k).alias("host"), tail(k + 1).alias("up")))
    nearest = hosts.where(F.size(labels) > 2).select(F.explode(steps).alias("s")).select("s.*").distinct()
    both = nearest.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("w"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(seeds: DataFrame, edges: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank for each kind of seed, from seeds (kind, host, seed)
    that sum up to 1 per kind and edges (kind, src, dst, p) whose p sum up to 1 per kind and src, after
    a given number of steps; `fixed_point` has what they lead to."""
    edges = settle(edges, "edges")
    seeds = settle(seeds, "seeds")
    out = edges.select("kind", F.col("src").alias("host")).distinct().withColumn("flows", F.lit(True))
    rank = settle(seeds.select("kind", "host", F.col("seed").alias("rank")), "rank")
    for _ in range(steps):
        moved = rank.join(edges, (rank.host == edges.src) & (rank.kind == edges.kind)).select(rank.kind, F.col("dst").alias("host"), (damping * F.col("rank") * F.col("p")).alias("rank"))
        back = {r["kind"]: r["x"] for r in rank.join(out, ["kind", "host"], "left").groupBy("kind").agg(F.sum(F.when(F.col("flows"), 1 - damping).otherwise(1.0) * F.col("rank")).alias("x")).collect()}
        share = F.lit(0.0)
        for kind, x in back.items():
            share = F.when(F.col("kind") == kind, F.lit(float(x))).otherwise(share)
        restart = seeds.select("kind", "host", (F.col("seed") * share).alias("rank"))
        now = settle(moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "rank")
        drop(rank)
        rank = now
    return rank


def fixed_point(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): where `spread` leads to. What returns to the seeds only scales all ranks of a
    kind, so these are y = seed + damping * (y moved along the edges), divided by their sum. From
    y = seed on, no host's y falls, and the sum of what a step adds shrinks by `damping` at least."""
    edges = settle(edges, "edges")
    seeds = settle(seeds.select("kind", "host", F.col("seed").alias("rank")), "seeds")
    rank, moving, held = seeds, True, []
    while moving:
        now = rank
        for k in range(1, ROUND + 1):
            moved = now.join(edges, (now.host == edges.src) & (now.kind == edges.kind)).select(now.kind, F.col("dst").alias("host"), (damping * F.col("rank") * F.col("p")).alias("rank"))
            terms = moved.unionByName(seeds)
            if k < ROUND:
                now = terms.groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if k < ROUND and k % PLAN == 0:
                done, now = held, settle(now, "rank")
                drop(*done)
                held = [now]
        before = rank.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        now = settle(terms.withColumn("was", F.lit(0.0)).unionByName(before).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "rank")
        moving = bool(now.where(F.col("rank") - F.col("was") > SETTLED * F.col("rank")).limit(1).count())
        drop(*held)
        held = []
        if rank is not seeds:
            drop(rank)
        rank = now
        del now, moved, terms, before
        tidy(rank.sparkSession, 1)
    drop(edges, seeds)
    sums = rank.groupBy("kind").agg(F.sum("rank").alias("all"))
    return rank.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))


def judge(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    named = with_host(pages.select(id_col, url, html), url)
    name, verdict = by_rule(rules, F.col("host"), F.col("path"))
    judged = named.select(id_col, "host", "path", name.alias("rule"), verdict.alias("verdict"))
    marks = judged.where(F.col("verdict").isNotNull() & (F.col("host") != "")).groupBy(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("n"))
    totals = marks.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = marks.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed"))
    edges = host_edges(named, html)
    both = edges.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("src"), F.col("dst"), F.col("w")), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w")))).alias("e")).select("e.*")
    weights = both.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    rank = fixed_point(seeds, both.join(weights, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("p")))
    scores = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    out = judged.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    rest = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", rest).alias("verdict"), "trust", "distrust")
