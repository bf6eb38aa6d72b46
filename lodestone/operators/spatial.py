"""Joins of boxes on pages: which block a line's centre is in, which texts stand above and below a table.

A page is covered by cells. A box is dealt to the cells that it touches and a point to its own, so that
both meet by an equi-join on (page, cell), with no comparison of all with all; pages with many boxes are
spread over their cells. A box on a border lies in both cells; a pair that meets in several is kept once.
What meets does not depend on how many stand in the same place: of boxes with equal sides only the first in
order can win, and points or texts of the same place are compared once.
Boxes are (x0, y0, x1, y1) columns with x0 <= x1 and y0 <= y1; points on a border are inside at the left
and top edge and outside at the right and bottom one. Boxes with a null side touch nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 256.0


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def nearest(points: DataFrame, boxes: DataFrame, page: str, point_id: str, y: str, box_id: str, order: str, top: str) -> DataFrame:
    """(page, point_id, box_id): for each point the box of its page whose top edge is nearest in height,
    the first in order of those as near. Tops and points are merged by height: the nearest is the last
    top at or above or the first one below, so a page costs its rows and not their product."""
    tops = boxes.where(F.col(top).isNotNull()).groupBy(page, top).agg(F.min(F.struct(order, box_id)).alias("__box"))
    both = tops.select(page, F.col(top).alias("__y"), "__box", F.lit(None).cast(points.schema[point_id].dataType).alias(point_id), F.lit(0).alias("__point"))
    asked = points.select(page, F.col(y).cast("double").alias("__y"), F.lit(None).cast(both.schema["__box"].dataType).alias("__box"), point_id, F.lit(1).alias("__point"))
    rows = both.withColumn("__y", F.col("__y").cast("double")).unionByName(asked)
    held = F.when(F.col("__point") == 0, F.struct("__y", "__box"))
    up = Window.partitionBy(page).orderBy("__y", "__point").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(page).orderBy(F.desc("__y"), "__point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__above": F.last(held, True).over(up), "__below": F.last(held, True).over(down)}).where("__point = 1")
    # a point without a height takes the topmost box
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["__y"] - F.col("__y")).alias("d"), F.col(c)["__box"].alias("box")))
    best = F.array_min(F.array_compact(F.array(near("__above"), near("__below"))))["box"]
    return rows.select(page, point_id, best[box_id].alias(box_id)).where(F.col(box_id).isNotNull())


def assign(points: DataFrame, boxes: DataFrame, page: str, point_id: str, x: str, y: str, box_id: str, order: str, sides: tuple[str, str, str, str], cell: float = CELL) -> DataFrame:
    """(page, point_id, box_id): the first box in order that a point is in, else the one whose top edge
    is nearest in height. Points of pages without boxes are left out. Point ids are unique in a page."""
    boxes = boxes.groupBy(page, *sides).agg(F.min(F.struct(order, box_id)).alias("__first")).select(page, *sides, "__first.*")
    place = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    places = points.select(page, x, y).distinct().withColumn("__place", place)
    won = _assign(places, boxes, page, "__place", x, y, box_id, order, sides, cell).withColumnRenamed(page, "__page")
    return points.select(page, point_id, place.alias("__at")).join(won, F.col(page).eqNullSafe(F.col("__page")) & (F.col("__at") == F.col("__place"))).select(page, point_id, box_id)


def _assign(points: DataFrame, boxes: DataFrame, page: str, point_id: str, x: str, y: str, box_id: str, order: str, sides: tuple[str, str, str, str], cell: float) -> DataFrame:
    x0, y0, x1, y1 = sides
    dealt = boxes.where(" and ".join(f"{s} is not null" for s in sides)).withColumn("__cx", F.explode(_cells(F.col(x0), F.col(x1), cell))).withColumn("__cy", F.explode(_cells(F.col(y0), F.col(y1), cell)))
    dealt = dealt.select(page, "__cx", "__cy", F.struct(order, box_id).alias("__box"), *(F.col(s).alias(f"__{k}") for k, s in enumerate(sides)))
    at = points.select(page, point_id, F.col(x).alias("__x"), F.col(y).alias("__y"), F.floor(F.col(x) / cell).alias("__cx"), F.floor(F.col(y) / cell).alias("__cy"))
    inside = (F.col("__x") >= F.col("__0")) & (F.col("__x") < F.col("__2")) & (F.col("__y") >= F.col("__1")) & (F.col("__y") < F.col("__3"))
    found = at.join(dealt, [page, "__cx", "__cy"]).where(inside).groupBy(page, point_id).agg(F.min("__box").alias("__box"))
    found = found.select(page, point_id, F.col("__box")[box_id].alias(box_id))
    rest = points.join(found.select(page, point_id), [page, point_id], "left_anti")
    return found.unionByName(nearest(rest, boxes, page, point_id, y, box_id, order, y0))


def companions(texts: DataFrame, tables: DataFrame, page: str, text_id: str, table_id: str, text: str, sides: tuple[str, str, str, str], above: float = 72, below: float = 150, overlap: float = 0.35, cell: float = CELL) -> DataFrame:
    """(page, table_id, text_id, position, distance): the texts within `above` over a table or `below`
    under it that overlap it by at least `overlap` of the narrower one's width. Page numbers, and texts
    of the same place (to hundredths) and words as another text with a smaller id, are left out. A table is
    dealt to the cells from `above` over to `below` under it."""
    x0, y0, x1, y1 = (F.col(s) for s in sides)
    whole = " and ".join(f"{s} is not null" for s in sides)
    number = F.coalesce(F.trim(F.col(text)), F.lit("")).rlike(r"(?i)^(?:Page\s+)?\d+(?:\s+of\s+\d+)?$")
    t = texts.where(whole).where(~number & (F.trim(F.col(text)) != ""))
    box = F.array(*(F.round(s, 2) for s in (x0, y0, x1, y1)))
    t = t.select(page, text_id, *(F.col(s).alias(f"__t{k}") for k, s in enumerate(sides)), F.xxhash64(box, F.trim(F.col(text))).alias("__same"))
    # of texts with the same words and sides, and of tables with the same sides, the first stands for all
    t = t.groupBy(page, "__same", *(f"__t{k}" for k in range(4))).agg(F.min(F.struct(text_id)).alias("__one")).select("*", "__one.*").drop("__one")
    t = t.withColumn("__cx", F.explode(_cells(F.col("__t0"), F.col("__t2"), cell))).withColumn("__cy", F.explode(_cells(F.col("__t1"), F.col("__t3"), cell)))
    b = tables.where(whole).select(page, table_id, *(F.col(s).alias(f"__b{k}") for k, s in enumerate(sides)))
    b = b.groupBy(page, *(f"__b{k}" for k in range(4))).agg(F.min(F.struct(table_id)).alias("__one")).select("*", "__one.*").drop("__one")
    b = b.withColumn("__cx", F.explode(_cells(F.col("__b0"), F.col("__b2"), cell))).withColumn("__cy", F.explode(_cells(F.col("__b1") - above, F.col("__b3") + below, cell)))
    met = t.join(b, [page, "__cx", "__cy"])
    shared = F.greatest(F.lit(0.0), F.least("__t2", "__b2") - F.greatest("__t0", "__b0")) / F.greatest(F.lit(1.0), F.least(F.col("__t2") - F.col("__t0"), F.col("__b2") - F.col("__b0")))
    over, under = F.col("__b1") - F.col("__t3"), F.col("__t1") - F.col("__b3")
    position = F.when((over >= 0) & (over <= above), "above").when((over < 0) & (under >= 0) & (under <= below), "below")
    # of the cells in which a pair meets the first one tells of it
    first = (F.col("__cx") == F.greatest(F.floor(F.col("__t0") / cell), F.floor(F.col("__b0") / cell))) & (F.col("__cy") == F.greatest(F.floor(F.col("__t1") / cell), F.floor((F.col("__b1") - above) / cell)))
    near = met.where(first & (shared >= overlap)).withColumns({"position": position, "distance": F.round(F.when(over >= 0, over).otherwise(under), 1)}).where("position is not null")
    # a text may be near several tables: the first table has it, and of equal texts the first
    one = near.groupBy(page, "__same").agg(F.min(F.struct(table_id, text_id, "position", "distance")).alias("__one"))
    return one.select(page, "__one.*")
