"""Coverings of perimeters by cells: cells wholly inside answer alone, only border cells meet edges.

A fire's cells have a size by its extent, a power of two in metres, so its box spans few of them
whatever its area; border cells of many edges are cut finer, again and again. Dividing by such a
size is exact, so a cell's centre is inside by the very rule for points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.operators.geom import envelopes
from cinderframe.operators.raster import crossings, paired
from cinderframe.sources.scratch import written

#: Cells that a fire's box may span on its longer side (and one more, for its place on the grid), and the side of a finer cut.
SPAN, CUT = 4, 16
#: Edges above which a border cell is cut finer, and the smallest size as a power of two.
DENSE, LEAST = 256, 0
#: What an edge is widened by, in cells; a cell too many on the border costs work, one too few would be wrong.
SLACK = 2.0**-20
CELL = ["id", "lv", "gx", "gy"]


def scaled(edges: DataFrame) -> DataFrame:
    """edges with lv, and ends in cells of 2**lv metres."""
    return edges.select("id", "lv", *[(F.col(c) / F.pow(F.lit(2.0), "lv")).alias(c) for c in ("x0", "y0", "x1", "y1")])


def levels(edges: DataFrame, span: int) -> DataFrame:
    """(id, lv): the least size, as a power of two, of which a fire's box spans at most ``span``."""
    longest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1.0))
    return envelopes(edges).select("id", F.greatest(F.lit(LEAST), F.ceil(F.log2(longest / span))).cast("int").alias("lv"))


def touched(e: DataFrame) -> DataFrame:
    """(id, lv, gx, gy, x0, y0, x1, y1): scaled edges on every cell that they touch."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = e.withColumn("gy", F.explode(F.sequence(F.floor(low - SLACK), F.floor(high + SLACK))))

    def at(y: Column) -> Column:
        x = F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
        return F.least(F.greatest(x, F.least("x0", "x1")), F.greatest("x0", "x1"))

    bottom, top = at(F.greatest(F.col("gy") - SLACK, low)), at(F.least(F.col("gy") + 1 + SLACK, high))
    flat = F.col("y0") == F.col("y1")
    a = F.when(flat, F.least("x0", "x1")).otherwise(F.least(bottom, top))
    b = F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest(bottom, top))
    cells = F.explode(F.sequence(F.floor(a - SLACK), F.floor(b + SLACK))).alias("gx")
    return rows.select("id", "lv", cells, "gy", "x0", "y0", "x1", "y1")


def of_dense(cells: DataFrame, dense: DataFrame) -> DataFrame:
    """Finer cells that lie in a dense one (id, lv, gx, gy)."""
    up = dense.select("id", F.col("gx").alias("px"), F.col("gy").alias("py"))
    mine = cells.withColumn("px", F.floor(F.col("gx") / CUT)).withColumn("py", F.floor(F.col("gy") / CUT))
    return mine.join(up, ["id", "px", "py"], "left_semi").drop("px", "py")


def layer(edges: DataFrame, dense: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(inside, border) of one size a fire: (id, lv, gx, gy), border with its number of edges; with dense only the cells in those."""
    e = scaled(edges)
    border = touched(e)
    runs = paired(crossings(e, 1), 1)
    if dense is None:
        cells = runs.select("id", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("gx"), F.col("row").alias("gy"))
    else:
        border = of_dense(border, dense)
        up = dense.select("id", F.col("gx").alias("px"), F.col("gy").alias("py"))
        runs = runs.withColumn("py", F.floor(F.col("row") / CUT)).join(up, ["id", "py"])
        first, last = F.greatest("c0", F.col("px") * CUT), F.least(F.col("c1") - 1, F.col("px") * CUT + CUT - 1)
        cells = runs.where(first <= last).select("id", F.explode(F.sequence(first, last)).alias("gx"), F.col("row").alias("gy"))
    border = written(border.groupBy(*CELL).agg(F.count("*").alias("edges")), "border-cells")
    cells = cells.join(edges.select("id", "lv").distinct(), "id").select(*CELL)
    return cells.join(border, CELL, "left_anti"), border


def covering(edges: DataFrame, span: int = SPAN, dense: int = DENSE) -> DataFrame:
    """(id, lv, gx, gy, inside), written: cells of 2**lv metres, wholly inside or on the border.

    A point of no cell is outside. Cells of one fire don't overlap. A border cell of more than ``dense`` edges is
    cut into finer ones down to a metre; each cut is one pass over the edges of the fires it meets.
    """
    edges = written(edges.join(levels(edges, span), "id"), "levelled-edges")
    out, cut = None, None
    while True:
        inside, border = layer(edges, cut)
        fine = (F.col("edges") <= dense) | (F.col("lv") < LEAST + 4)
        found = inside.select(*CELL, F.lit(True).alias("inside")).unionByName(border.where(fine).select(*CELL, F.lit(False).alias("inside")))
        found = written(found, "covering-cells")
        out = found if out is None else out.unionByName(found)
        cut = written(border.where(~fine).select(*CELL), "dense-cells")
        if not cut.limit(1).count():
            return out
        edges = written(edges.join(cut.select("id").distinct(), "id", "left_semi").withColumn("lv", F.col("lv") - 4), "levelled-edges")


def met(points: DataFrame, cover: DataFrame) -> DataFrame:
    """(pt, x, y, id, inside): points (pt, x, y) with the covering's cells that hold them, by an equi-join.

    A point asks once for each size in use, at most one a power of two.
    """
    sizes = [r["lv"] for r in cover.select("lv").distinct().collect()]
    asked = points.select("pt", "x", "y", F.explode(F.array(*[F.lit(s) for s in sizes]) if sizes else F.array().cast("array<int>")).alias("lv"))
    size = F.pow(F.lit(2.0), "lv")
    asked = asked.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))
    return asked.join(cover, ["lv", "gx", "gy"]).select("pt", "x", "y", "id", "inside")
