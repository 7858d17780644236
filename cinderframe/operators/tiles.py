"""Tile layers: assignment to web-mercator tiles, clipping, per-zoom thinning, size policy, assembly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinderframe.operators import ragged
from cinderframe.sources.scratch import written


def tile_x(lon: Column, z: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), z)).cast("long")


def tile_y(lat: Column, z: Column) -> Column:
    r = F.radians(lat)
    return F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.lit(math.pi)) / 2.0 * F.pow(F.lit(2.0), z)).cast("long")


def tiles_of(boxes: DataFrame, zooms: tuple[int, int]) -> DataFrame:
    """Features (id, lon0, lat0, lon1, lat1) on every tile (z, x, y) that their box touches."""
    b = boxes.withColumn("z", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))))
    b = b.withColumn("x", F.explode(F.sequence(tile_x(F.col("lon0"), F.col("z")), tile_x(F.col("lon1"), F.col("z")))))
    return b.withColumn("y", F.explode(F.sequence(tile_y(F.col("lat1"), F.col("z")), tile_y(F.col("lat0"), F.col("z")))))


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut to a box, side by side; empty if nothing is left."""
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        if not len(ring):
            break
        d = sign * (ring[:, axis] - bound)
        nxt, dn = np.roll(ring, -1, 0), np.roll(d, -1)
        cross = d * dn < 0
        t = np.where(cross, d / np.where(cross, d - dn, 1.0), 0.0)[:, None]
        both = np.stack((ring, ring + (nxt - ring) * t), axis=1)  # each point, then where its side is crossed
        ring = both[np.stack((d >= 0, cross), axis=1)]
    return ring


#: Points that are cut at a time.
POINTS_HELD = 2_000_000


def blocks_areas(r: ragged.Rings, size: float) -> np.ndarray:
    """The signed area of each ring as the sum of its pieces in square blocks, each piece cut out of the ring."""
    x0, y0, x1, y1 = (np.floor(np.where(r.sizes > 0, c, 0.0) / size).astype(np.int64) for c in r.low_high())
    nx, ny = x1 - x0 + 1, y1 - y0 + 1
    out = np.zeros(len(r))
    one = nx * ny == 1
    out[one] = r.areas()[one]  # in one block: not cut
    left = np.flatnonzero(~one)
    many = (nx * ny)[left]
    held = np.cumsum(many * r.sizes[left]) // POINTS_HELD
    for mine in np.split(np.arange(len(left)), np.flatnonzero(np.diff(held)) + 1):
        own = np.repeat(left[mine], many[mine])
        i = np.arange(len(own)) - np.repeat(np.cumsum(many[mine]) - many[mine], many[mine])
        step = max(1, POINTS_HELD // max(1, int(r.sizes[own].max(initial=1))))
        for a in range(0, len(own), step):
            o, k = own[a : a + step], i[a : a + step]
            bx, by = (x0[o] + k % nx[o]) * size, (y0[o] + k // nx[o]) * size
            piece = r.take(o)
            for axis, bound, sign in ((0, bx, 1), (0, bx + size, -1), (1, by, 1), (1, by + size, -1)):
                piece = ragged.sided(piece, axis, bound, sign)
            np.add.at(out, o, piece.areas())
    return out


def cut_areas(rings: DataFrame, size: float) -> DataFrame:
    """(id, ring, area) of open rings (id, part, ring, xs, ys): each ring's area as its pieces in blocks add it up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            area = np.abs(blocks_areas(ragged.of_lists(b["xs"], b["ys"]), size))
            yield pa.RecordBatch.from_arrays([b["id"], b["ring"], pa.array(area)], ["id", "ring", "area"])

    return rings.select("id", "ring", "xs", "ys").mapInArrow(run, "id string, ring int, area double")


def thinned_sums(rings: DataFrame) -> DataFrame:
    """(z, n, m): points of closed rings before and after thinning by a zoom's pixel, for rings (xs, ys: open; zs: its zooms, eps: their pixels)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            closed = ragged.closed(ragged.of_lists(b["xs"], b["ys"]))
            own = np.repeat(np.arange(len(b)), np.diff(np.asarray(b["zs"].offsets)))
            zs, eps = (b[c].flatten().to_numpy(zero_copy_only=False) for c in ("zs", "eps"))
            for z in np.unique(zs):
                at = own[zs == z]
                r = closed.take(at)
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (int(z), len(r.x), int(ragged.thinned(r, eps[zs == z]).sum()))], ["z", "n", "m"])

    return rings.select("xs", "ys", "zs", "eps").mapInArrow(run, "z long, n long, m long").groupBy(F.col("z").cast("int").alias("z")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


TILE = ("layer", "year", "z", "x", "y")


def pixel(z: Column) -> Column:
    """The size of a tile's pixel (a 4096th) in degrees."""
    return 360.0 / F.pow(F.lit(2.0), z) / 4096


def visible(features: DataFrame, deepest: int, degree: float = 1.0) -> DataFrame:
    """Features (z, area) without those smaller than a pixel, all at the deepest zoom; ``degree``: a degree in area's units."""
    return features.where((F.col("z") == deepest) | (F.col("area") >= F.pow(pixel(F.col("z")) * degree, F.lit(2.0))))


def visible_zooms(area: Column, zooms: tuple[int, int], degree: float = 1.0) -> Column:
    """The zooms in which visible() has a feature of that area."""
    return F.filter(F.sequence(F.lit(zooms[0]), F.lit(zooms[1])), lambda z: (z == zooms[1]) | (area >= F.pow(pixel(z) * degree, F.lit(2.0))))


def within_budget(features: DataFrame, budget: int, salts: int = 32) -> DataFrame:
    """Tile features with ``own``: in the layer as they are while the tile's bytes, largest first, fit.

    A tile may hold a fixed share of all features. What doesn't fit among its salt's own features
    doesn't fit among all, so each salt first keeps what fits by itself: at most a budget's worth
    reaches the window of a tile. Of those, a feature fits if the larger ones leave it room and none
    of the larger ones was left out.
    """
    order = (F.desc("area"), "id")
    f = features.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    part = W.partitionBy(*TILE, "salt").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    f = written(f.withColumn("fits", F.sum("bytes").over(part) <= budget).drop("salt"), "tile-fits")  # read twice
    out = f.where("not fits").groupBy(*TILE).agg(F.min(F.struct((-F.col("area")).alias("a"), "id")).alias("first"))
    upto = W.partitionBy(*TILE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    kept = f.where("fits").withColumn("sum", F.sum("bytes").over(upto)).join(out, list(TILE), "left")
    before = F.col("first").isNull() | (F.struct((-F.col("area")).alias("a"), "id") < F.col("first"))
    kept = kept.withColumn("own", (F.col("sum") <= budget) & before).drop("sum", "first", "fits")
    return kept.unionByName(f.where("not fits").withColumn("own", F.lit(False)).drop("fits"))


def merged_tail(features: DataFrame, budget: int) -> DataFrame:
    """Features that fit, and one merged feature per tile and class (id null) for those that don't."""
    f = within_budget(features, budget)
    kept = f.where("own").select(*TILE, "id", "class", "area", F.lit(1).cast("long").alias("parts"))
    tail = f.where("not own").groupBy(*TILE, "class").agg(F.sum("area").alias("area"), F.count("*").alias("parts"))
    return kept.unionByName(tail.select(*TILE, F.lit(None).cast("string").alias("id"), "class", "area", "parts"))


def inventory(tiles: DataFrame) -> DataFrame:
    """(year, ids, vertices) of the deepest zoom of tile rows."""
    deepest = F.broadcast(tiles.agg(F.max("z").alias("z")))
    f = tiles.join(deepest, "z").select(F.explode("features").alias("f")).select(F.col("f.fire_year").alias("year"), "f.id", "f.nv")
    per_id = f.groupBy("year", "id").agg(F.sum("nv").alias("nv"))
    return per_id.groupBy("year").agg(F.count("*").alias("ids"), F.sum("nv").alias("vertices"))
