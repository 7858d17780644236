"""Raster work on runs (row, c0, c1): rasterising, burn counts, levels, components, sieve, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinderframe.functions.scalar import acres
from cinderframe.operators.labels import label_components
from cinderframe.sources.scratch import written

CELL = 90


def crossings(edges: DataFrame, cell: int = CELL) -> DataFrame:
    """(id, row, x): where edges cross the lines of cell centres, an edge's upper end left out."""
    half = cell / 2
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil((low - half) / cell), F.ceil((high - half) / cell) - 1
    rows = edges.where(last >= first).withColumn("row", F.explode(F.sequence(first, last)))
    yc = F.col("row") * cell + F.lit(half)
    x = F.col("x0") + (yc - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    return rows.select("id", F.col("row").cast("long").alias("row"), x.alias("x"))


def paired(cross: DataFrame, cell: int) -> DataFrame:
    """(id, row, c0, c1) of crossings (id, row, x): the cells with their centre between the odd and the even ones of a row."""
    by = W.partitionBy("id", "row").orderBy("x")
    pairs = cross.select("id", "row", "x", F.lead("x").over(by).alias("x2"), F.row_number().over(by).alias("i")).where("i % 2 = 1")
    half = cell / 2
    c0, c1 = (F.ceil((F.col(c) - half) / cell).cast("long").alias(n) for c, n in (("x", "c0"), ("x2", "c1")))
    return pairs.select("id", "row", c0, c1).where("c0 < c1")


def rasterise(edges: DataFrame, cell: int = CELL) -> DataFrame:
    """(id, row, c0, c1): cells whose centre is inside a polygon, even-odd, c1 exclusive.

    Crossings of a row are paired in order of x; work follows edges and rows, never whole polygons.
    """
    return paired(crossings(edges, cell), cell)


def sweep(runs: DataFrame, **flags: Column) -> DataFrame:
    """(row, c0, c1, n, flags...): how many runs hold each cell, and how many of those with a flag.

    Work follows the runs' ends, not the cells; ends meet in partial sums before the window by row.
    """
    ends = F.explode(F.array(F.struct(F.col("c0").alias("col"), F.lit(1).alias("d")), F.struct(F.col("c1").alias("col"), F.lit(-1).alias("d")))).alias("e")
    deltas = runs.select("row", *[v.cast("int").alias(k) for k, v in flags.items()], ends)
    sums = [F.sum(F.col("e.d") * (F.col(k) if k in flags else 1)).alias(k) for k in ("n", *flags)]
    at = deltas.groupBy("row", F.col("e.col").alias("c0")).agg(*sums)
    along = W.partitionBy("row").orderBy("c0")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    out = at.select("row", "c0", F.lead("c0").over(along).alias("c1"), *[F.sum(k).over(upto).cast("int").alias(k) for k in ("n", *flags)])
    return out.where("n > 0")


def counted(differences: DataFrame) -> DataFrame:
    """(row, c0, c1, n) of differences (row, col, d): how much the count changes at a column."""
    along = W.partitionBy("row").orderBy("col")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    out = differences.select("row", F.col("col").alias("c0"), F.lead("col").over(along).alias("c1"), F.sum("d").over(upto).cast("int").alias("n"))
    return out.where("n > 0")


def cells(by: str, runs: DataFrame) -> DataFrame:
    return runs.groupBy(by).agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"))


def patches_per_count(labelled: DataFrame, cell: int = CELL) -> DataFrame:
    """(n, patches, cells, acres) of runs with their region (label_components())."""
    by = labelled.groupBy("n", "comp").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"))
    by = by.groupBy("n").agg(F.count("*").alias("patches"), F.sum("cells").alias("cells"))
    return by.select("n", "patches", "cells", F.round(acres(F.col("cells") * (cell * cell))).cast("long").alias("acres"))


def acres_at_levels(runs: DataFrame, cell: int = CELL) -> DataFrame:
    """(level, acres, cells): a level holds all counts from it up. One row a count meets the window."""
    down = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("cells").over(down)
    return cells("n", runs).select(F.col("n").alias("level"), total.alias("cells"), F.round(acres(total * (cell * cell))).cast("long").alias("acres"))


def burned_shares(runs: DataFrame) -> DataFrame:
    """Share of the burned ground burned once, twice, three times, and four or more."""
    by = runs.groupBy(F.least("n", F.lit(4)).alias("times")).agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"))
    return by.select("times", "cells", F.round(F.col("cells") / F.sum("cells").over(W.partitionBy(F.lit(1))), 6).alias("share"))


def overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = 64) -> DataFrame:
    """Pairs of runs of two tables that share cells, with their common c0 and c1.

    Keys: columns of both besides the column range, which is cut into buckets so that a pair meets
    in the bucket of its common start; other columns must differ in name.
    """
    def cut(d: DataFrame, s: str) -> DataFrame:
        d = d.withColumnsRenamed({"c0": f"c0{s}", "c1": f"c1{s}"})
        return d.withColumn("__b", F.explode(F.sequence(F.floor(F.col(f"c0{s}") / bucket), F.floor((F.col(f"c1{s}") - 1) / bucket))))

    both = cut(left, "_l").join(cut(right, "_r"), [*keys, "__b"])
    c0, c1 = F.greatest("c0_l", "c0_r"), F.least("c1_l", "c1_r")
    both = both.where((c0 < c1) & (F.col("__b") == F.floor(c0 / bucket)))
    return both.select("*", c0.alias("c0"), c1.alias("c1")).drop("__b", "c0_l", "c1_l", "c0_r", "c1_r")


def zonal_histogram(fire_runs: DataFrame, mosaic: DataFrame) -> DataFrame:
    """(id, class, px): cells of each class inside each fire of the mosaic's year, classes 1 to 6."""
    inside = overlap(fire_runs.select("id", "year", "row", "c0", "c1"), mosaic.where("class between 1 and 6"), ["year", "row"])
    return inside.groupBy("id", "class").agg(F.sum(F.col("c1") - F.col("c0")).cast("long").alias("px"))


def clip(mosaic: DataFrame, region: DataFrame) -> DataFrame:
    """The mosaic's runs inside a region's runs (row, c0, c1)."""
    return overlap(mosaic, region.select("row", "c0", "c1"), ["row"]).select("year", "row", "c0", "c1", "class")


def tiled_rows(runs: DataFrame) -> DataFrame:
    """Runs with the gaps between them, and one row and column all round, as runs of value 0."""
    box = F.broadcast(runs.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("c0").alias("lo"), F.max("c1").alias("hi")))
    rows = box.where("r0 is not null").select(F.explode(F.sequence(F.col("r0") - 1, F.col("r1") + 1)).alias("row"), (F.col("lo") - 1).alias("lo"), (F.col("hi") + 1).alias("hi"))
    ends = runs.select("row", "c0", "c1").unionByName(rows.select("row", F.col("lo").alias("c0"), F.col("lo").alias("c1"))).unionByName(rows.select("row", F.col("hi").alias("c0"), F.col("hi").alias("c1")))
    along = W.partitionBy("row").orderBy("c0", "c1")
    gaps = ends.select("row", F.col("c1").alias("g0"), F.lead("c0").over(along).alias("g1")).where("g0 < g1")
    return runs.select("row", "c0", "c1", "n").unionByName(gaps.select("row", F.col("g0").alias("c0"), F.col("g1").alias("c1"), F.lit(0).alias("n")))


def touching(runs: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of runs (rid, row, c0, c1, n) that share a side, each pair once."""
    up = runs.select(F.col("rid").alias("a"), F.col("n").alias("na"), (F.col("row") + 1).alias("row"), "c0", "c1")
    below = overlap(up, runs.select(F.col("rid").alias("b"), F.col("n").alias("nb"), "row", "c0", "c1"), ["row"]).select("a", "na", "b", "nb")
    left = runs.select(F.col("rid").alias("a"), F.col("n").alias("na"), "row", F.col("c1").alias("c"))
    beside = left.join(runs.select(F.col("rid").alias("b"), F.col("n").alias("nb"), "row", F.col("c0").alias("c")), ["row", "c"]).select("a", "na", "b", "nb")
    return below.unionByName(beside)


def sieve(runs: DataFrame, least: int) -> DataFrame:
    """Runs after regions of fewer than ``least`` cells take their largest neighbour's value.

    One pass; nodata counts as value 0, its outer region as of unlimited size; the neighbour must
    itself have ``least`` cells (else the speck stays); ties go to the smaller value, then region.
    Runs of value 0 are dropped at the end, and neighbours of one value are not merged.
    """
    lab = written(label_components(tiled_rows(runs)), "sieve-labels")
    size = lab.groupBy("comp", "n").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"), F.min("row").alias("top"))
    edge = F.broadcast(lab.agg(F.min("row").alias("edge")))
    size = written(size.join(edge).select("comp", "n", F.when((F.col("n") == 0) & (F.col("top") == F.col("edge")), F.lit(2**62)).otherwise(F.col("cells")).alias("cells")), "sieve-sizes")
    key = lab.select("rid", "comp")
    near = touching(lab.select("rid", "row", "c0", "c1", "n")).where("na <> nb")
    near = near.join(key.withColumnsRenamed({"rid": "a", "comp": "ca"}), "a").join(key.withColumnsRenamed({"rid": "b", "comp": "cb"}), "b")
    near = near.select("ca", "cb").unionByName(near.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct()
    specks = size.where(F.col("cells") < least).select(F.col("comp").alias("ca"))
    big = size.where(F.col("cells") >= least).select(F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("cells").alias("size"))
    best = F.max(F.struct("size", (-F.col("nb")).alias("v"), (-F.col("cb")).alias("c")))
    new = near.join(specks, "ca").join(big, "cb").groupBy("ca").agg((-best["v"]).alias("n_new"))
    out = lab.join(new, lab["comp"] == new["ca"], "left")
    return out.select("row", "c0", "c1", F.coalesce("n_new", "n").cast("int").alias("n")).where("n > 0")


def patches(runs: DataFrame, cell: int = CELL) -> DataFrame:
    """(comp, n, cells, acres, perimeter): regions of equal n; perimeter in cell sides.

    A side of a cell is on the boundary unless a cell of the same region is behind it, so the
    perimeter is each run's sides less twice what neighbouring runs of a region share.
    """
    lab = written(label_components(runs), "patch-labels")
    up = lab.select("comp", (F.col("row") + 1).alias("row"), "c0", "c1")
    shared = overlap(up, lab.select("comp", "row", "c0", "c1"), ["comp", "row"]).groupBy("comp").agg(F.sum(F.col("c1") - F.col("c0")).alias("shared"))
    ends = lab.select("comp", "row", F.col("c1").alias("c")).join(lab.select("comp", "row", F.col("c0").alias("c")), ["comp", "row", "c"])
    ends = ends.groupBy("comp").agg(F.count("*").alias("met"))
    by = lab.groupBy("comp", "n").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"), F.count("*").alias("runs"))
    out = by.join(shared, "comp", "left").join(ends, "comp", "left")
    per = 2 * (F.col("cells") + F.col("runs") - F.coalesce("shared", F.lit(0)) - F.coalesce("met", F.lit(0)))
    return out.select("comp", "n", "cells", F.round(acres(F.col("cells") * (cell * cell))).cast("long").alias("acres"), per.alias("perimeter"))
