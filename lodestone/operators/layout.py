"""Faults of rendered pages: texts outside their page, fragments at its edge, texts upon each other, and
stacks of single CJK characters. What a line meets is looked for a bounded number of lines ahead, so
pages of any length are cut into segments, each with the lines that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import SEGMENT, positions

CJK = r"[\x{3400}-\x{9fff}]"
#: How many lines ahead an overlap, and the next character of a stack, may be.
OVERLAP_AHEAD, STACK_AHEAD = 9, 7
_BOX = ("x0", "y0", "x1", "y1")


def ahead(placed: DataFrame, group: str, most: int, row: Column, segment: int = SEGMENT, derived: dict[str, Column] | None = None) -> DataFrame:
    """Adds __ahead, an array of `row` of the up to `most` rows of the group that follow in place (__i of
    `positions`). Columns `derived` from the others, and `row`, are made after the rows are dealt."""
    seg = F.floor(F.col("__i") / segment)
    rows = placed.withColumn("__seg", F.explode(F.when((F.col("__i") % segment < most) & (seg > 0), F.array(seg, seg - 1)).otherwise(F.array(seg)))).repartition(group, "__seg").withColumns(derived or {})
    frame = Window.partitionBy(group, "__seg").orderBy("__i").rowsBetween(1, most)
    return rows.withColumn("__ahead", F.collect_list(row).over(frame)).where(F.col("__seg") == seg).drop("__seg")


def _area(b) -> Column:
    return F.greatest(b("x1") - b("x0"), F.lit(0.0)) * F.greatest(b("y1") - b("y0"), F.lit(0.0))


def _of(x: Column):
    return lambda c: x.getField(c)


def _here(c: str) -> Column:
    return F.col(f"__{c}")


def _covers(a, b) -> Column:
    """The share of the smaller of two boxes that the other one covers."""
    wide = F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0"))
    high = F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0"))
    return F.when((wide > 0) & (high > 0), wide * high / F.greatest(F.lit(1.0), F.least(_area(a), _area(b)))).otherwise(0.0)


def _upon(a, b, median: Column) -> Column:
    """Whether two texts of which one is CJK lie upon each other: not the same text twice, not neighbours
    in a line, one of them short and one prominent."""
    mixed = ((a("cjk") > 0) & ((b("cjk") > 0) | (b("latin") >= 2))) | ((b("cjk") > 0) & (a("latin") >= 2))
    left, right = a("letters"), b("letters")
    shorter, longer = F.when(F.length(left) <= F.length(right), left).otherwise(right), F.when(F.length(left) <= F.length(right), right).otherwise(left)
    twice = (shorter != "") & ((left == right) | ((F.length(shorter) >= 6) & F.contains(longer, shorter)))
    in_line = F.abs((a("y0") + a("y1")) / 2 - (b("y0") + b("y1")) / 2) <= 2.0
    share = _covers(a, b)
    prominent = F.greatest(a("size"), b("size")) >= F.greatest(F.lit(11.5), median * 1.15)
    return mixed & (share >= 0.65) & ~twice & ~(in_line & (share < 0.82)) & (F.length(shorter) <= 12) & prominent


def layout_issues(lines: DataFrame, page: str, text: str, size: str, frame: tuple[str, str, str, str], median: str, order: list[str], segment: int = SEGMENT) -> DataFrame:
    """(page, kind, evidence, x0, y0, x1, y1) of the faults of lines with boxes x0, y0, x1, y1. `frame`
    names the columns of the page's own box, `median` that of its median text size; `order` tells lines
    with the same corner apart. Lines are taken by their tops, then their left edges.

    * clipped: a box that leaves the page by more than 0.5, and once more a fragment of one character at
      its edge (a CJK one within 2 of either side, any letter of size 6.5 or more in its right quarter);
    * overlap: the first line ahead that lies upon this one, of at most nine and before one that begins
      more than 3 below it;
    * stack: the first of a page's single characters that begins a column of three or more.

    Null texts are empty. Letters are compared in lower case."""
    said = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    d = lines.select(F.col(page), *(F.col(c) for c in order if c != page and c not in _BOX), said.alias("__text"), F.col(size).cast("double").alias("__size"), F.col(median).cast("double").alias("__median"), *(F.col(c).cast("double").alias(f"__{c}") for c in _BOX), *(F.col(c).cast("double").alias(f"__p{k}") for c, k in zip(frame, _BOX, strict=True)))
    letters = F.lower(F.regexp_replace("__text", r"[^0-9A-Za-z\x{3400}-\x{9fff}]+", ""))
    bare = F.regexp_replace("__text", r"\s", "")
    cjk = F.regexp_count("__text", F.lit(CJK))
    single = (cjk == 1) & (F.length(bare) <= 2)
    derived = {"__cjk": cjk, "__latin": F.regexp_count("__text", F.lit("[A-Za-z]")), "__letters": letters, "__bare": F.length(bare), "__single": single}
    ties = [c for c in order if c != page and c not in _BOX]
    placed = positions(d, page, ["__y0", "__x0", *ties])
    parts = ("text", "size", "cjk", "latin", "letters", *_BOX)
    seen = ahead(placed, page, OVERLAP_AHEAD, F.struct(*(_here(c).alias(c) for c in parts)), segment, derived)
    below = F.transform("__ahead", lambda b: b["y0"] > _here("y1") + 3)
    near = F.when(F.array_contains(below, True), F.slice("__ahead", 1, (F.array_position(below, True) - 1).cast("int"))).otherwise(F.col("__ahead"))
    hit = F.get(F.filter(near, lambda b: _upon(_here, _of(b), F.col("__median"))), F.lit(0))
    out = (_here("x0") < F.col("__px0") - 0.5) | (_here("y0") < F.col("__py0") - 0.5) | (_here("x1") > F.col("__px1") + 0.5) | (_here("y1") > F.col("__py1") + 0.5)
    lone = (F.col("__bare") == 1) & F.col("__letters").rlike("[^0-9]") & (_here("x0") > (F.col("__px1") - F.col("__px0")) * 0.72) & (F.col("__size") >= 6.5)
    edge = (F.col("__single") & ((_here("x1") >= F.col("__px1") - 2) | (_here("x0") <= F.col("__px0") + 2))) | lone
    own = [_here(c).alias(c) for c in _BOX]
    issue = lambda kind, said, box: F.struct(F.lit(kind).alias("kind"), said.alias("evidence"), *box)
    both = [F.least(_here(c), F.col("__hit").getField(c)).alias(c) if c[1] == "0" else F.greatest(_here(c), F.col("__hit").getField(c)).alias(c) for c in _BOX]
    found = seen.withColumn("__hit", hit).select(page, F.explode(F.array_compact(F.array(
        F.when(out, issue("clipped", F.concat(F.lit("outside: "), F.left("__text", F.lit(80))), own)), F.when(edge, issue("clipped", F.concat(F.lit("fragment: "), F.left("__text", F.lit(20))), own)),
        F.when(F.col("__hit").isNotNull(), issue("overlap", F.concat(F.left("__text", F.lit(40)), F.lit(" / "), F.left(F.col("__hit").getField("text"), F.lit(40))), both)),
    ))).alias("__f"))
    return found.select(page, "__f.*").unionByName(_stacks(placed.where(single), page, ties, segment))


def _stacks(placed: DataFrame, page: str, ties: list[str], segment: int) -> DataFrame:
    """The first column of three or more single characters of each page."""
    singles = positions(placed.select(page, *ties, "__text", *(f"__{c}" for c in _BOX)), page, ["__y0", "__x0", *ties])
    seen = ahead(singles, page, STACK_AHEAD, F.struct(*(_here(c).alias(c) for c in ("text", *_BOX))), segment)
    first = F.struct(*(_here(c).alias(c) for c in ("text", *_BOX)))

    def grow(state: Column, b: Column) -> Column:
        last = F.element_at(state["members"], -1)
        mid = lambda r: (r["x0"] + r["x1"]) / 2
        column = F.abs(mid(b) - mid(last)) <= F.greatest(F.lit(5.0), (last["x1"] - last["x0"]) * 1.4)
        close = (b["y0"] - last["y1"]).between(0, F.greatest(F.lit(16.0), (last["y1"] - last["y0"]) * 2.2))
        on = state["open"] & column & close
        return F.struct(on.alias("open"), F.when(on, F.concat(state["members"], F.array(b))).otherwise(state["members"]).alias("members"))

    members = F.aggregate("__ahead", F.struct(F.lit(True).alias("open"), F.array(first).alias("members")), grow, lambda s: s["members"])
    stacks = seen.select(page, "__i", members.alias("m")).where(F.size("m") >= 3).groupBy(page).agg(F.min_by("m", "__i").alias("m"))
    side = lambda c: (F.array_min if c[1] == "0" else F.array_max)(F.transform("m", lambda r: r[c])).alias(c)
    return stacks.select(page, F.lit("stack").alias("kind"), F.array_join(F.transform("m", lambda r: r["text"]), "").alias("evidence"), *(side(c) for c in _BOX))
