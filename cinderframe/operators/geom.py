"""Geometry as tables: nested parts, edges, areas, distances, projection, simplification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An array of points; a type, not a string, so that tasks can import this module.
POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
#: Albers equal-area conic of the contiguous states (EPSG:5070): fixed parameters.
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0, "a": 6378137.0, "f": 1 / 298.257222101}


def nest(edges: DataFrame) -> DataFrame:
    """(id, geom): edges folded to parts of closed rings of points."""
    point = F.struct("seq", F.struct(F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")).alias("p"))
    rings = edges.groupBy("id", "part", "ring").agg(F.sort_array(F.collect_list(point)).alias("r"))
    ring = F.transform("r", lambda s: s["p"])
    rings = rings.select("id", "part", "ring", F.concat(ring, F.slice(ring, 1, 1)).alias("pts"))
    parts = rings.groupBy("id", "part").agg(F.sort_array(F.collect_list(F.struct("ring", "pts"))).alias("rs"))
    parts = parts.select("id", "part", F.transform("rs", lambda s: s["pts"]).alias("rings"))
    whole = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "rings"))).alias("ps"))
    return whole.select("id", F.transform("ps", lambda s: s["rings"]).alias("geom"))


def closed_rings(edges: DataFrame) -> DataFrame:
    """(id, part, ring, pts): each ring's points in order, the first again at the end."""
    point = F.struct("seq", F.struct(F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")).alias("p"))
    rings = edges.groupBy("id", "part", "ring").agg(F.transform(F.sort_array(F.collect_list(point)), lambda s: s["p"]).alias("r"))
    return rings.select("id", "part", "ring", F.concat("r", F.slice("r", 1, 1)).alias("pts"))


def open_rings(edges: DataFrame, *more: str) -> DataFrame:
    """(id, part, ring, more, xs, ys): each ring's points in order as two lists, the first not again at the end.

    more: columns that all edges of an id share.
    """
    point = F.struct("seq", F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    rings = edges.groupBy("id", "part", "ring", *more).agg(F.sort_array(F.collect_list(point)).alias("r"))
    return rings.select("id", "part", "ring", *more, F.col("r.x").alias("xs"), F.col("r.y").alias("ys"))


def ring_area(pts: Column) -> Column:
    """Signed area of a ring of points, closed or not."""
    nxt = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
    return F.aggregate(F.zip_with(pts, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def fidelity(edges: DataFrame, eps: float) -> DataFrame:
    """One row: features, rings, vertices and area before and after thinning every ring by ``eps``.

    A ring that is left with fewer than four points is none.
    """
    rings = closed_rings(edges)
    def sums(r: DataFrame, suffix: str) -> DataFrame:
        area = F.abs(ring_area(F.col("pts")))
        return r.agg(F.countDistinct("id").alias(f"fires{suffix}"), F.count("*").alias(f"rings{suffix}"), F.coalesce(F.sum(F.size("pts") - 1), F.lit(0)).cast("long").alias(f"vertices{suffix}"),
                     F.coalesce(F.sum(F.when(F.col("ring") == 0, area).otherwise(-area)), F.lit(0.0)).alias(f"area{suffix}"))

    after = simplified(rings.repartition("id", "part", "ring"), eps).where("size(pts) >= 4")
    return sums(rings, "").crossJoin(sums(after, "_thin"))  # one row each


def repair(geom: Column) -> Column:
    """Rings closed, and those of fewer than four points dropped, then parts without rings.

    Crossing rings need no more: counting is even-odd, and areas are taken per ring.
    """
    def closed(r: Column) -> Column:
        return F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))

    parts = F.transform(geom, lambda p: F.filter(F.transform(F.filter(p, lambda r: F.size(r) > 0), closed), lambda r: F.size(r) >= 4))
    return F.filter(parts, lambda p: F.size(p) > 0)


def edges_of(shapes: DataFrame, id_: str = "id", geom: str = "geom") -> DataFrame:
    """(id, part, ring, seq, x0, y0, x1, y1) of nested geometry, zero-length edges dropped."""
    parts = shapes.select(id_, F.posexplode(geom).alias("part", "rings"))
    rings = parts.select(id_, "part", F.posexplode("rings").alias("ring", "pts")).where("size(pts) > 1")
    ends = F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b"))
    e = rings.select(id_, "part", "ring", F.posexplode(ends).alias("seq", "e"))
    e = e.select(id_, "part", "ring", "seq", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))
    return e.where("x0 <> x1 or y0 <> y1")


def envelopes(edges: DataFrame) -> DataFrame:
    xs, ys = ("x0", "x1"), ("y0", "y1")
    return edges.groupBy("id").agg(F.min(F.least(*xs)).alias("xmin"), F.min(F.least(*ys)).alias("ymin"), F.max(F.greatest(*xs)).alias("xmax"), F.max(F.greatest(*ys)).alias("ymax"))


def pixel_window(boxes: DataFrame, cell: int) -> DataFrame:
    """Rows and columns of each box, grown by one on every side."""
    low = [(F.floor(F.col(c) / cell) - 1).cast("long").alias(n) for c, n in (("xmin", "c_from"), ("ymin", "r_from"))]
    high = [(F.floor(F.col(c) / cell) + 1).cast("long").alias(n) for c, n in (("xmax", "c_to"), ("ymax", "r_to"))]
    return boxes.select("id", *low, *high)


def snapped_extent(edges: DataFrame, cell: int) -> DataFrame:
    """The extent of all edges, out to whole cells."""
    box = edges.agg(F.min(F.least("x0", "x1")).alias("xmin"), F.min(F.least("y0", "y1")).alias("ymin"), F.max(F.greatest("x0", "x1")).alias("xmax"), F.max(F.greatest("y0", "y1")).alias("ymax"))
    down = [(F.floor(F.col(c) / cell) * cell).cast("long").alias(c) for c in ("xmin", "ymin")]
    return box.select(*down, *[(F.ceil(F.col(c) / cell) * cell).cast("long").alias(c) for c in ("xmax", "ymax")])


def areas(edges: DataFrame) -> DataFrame:
    """(id, area): shoelace per ring, exteriors less holes. A ring that crosses itself may have none."""
    cross = F.sum((F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).cast("double")) / 2
    rings = edges.groupBy("id", "part", "ring").agg(F.abs(cross).alias("a"))
    return rings.groupBy("id").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x0) * dx + (py - y0) * dy) / n)))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _albers_constants() -> tuple[float, float, float, float]:
    e = math.sqrt(ALBERS["f"] * (2 - ALBERS["f"]))

    def q(lat: float) -> float:
        s = math.sin(lat)
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    p1, p2, p0 = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return e, n, c, ALBERS["a"] * math.sqrt(c - n * q(p0)) / n


def albers_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Projected metres of degrees: closed form, so a pair of column expressions."""
    e, n, c, rho0 = _albers_constants()
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = F.sqrt(c - n * q) * (ALBERS["a"] / n)
    theta = F.radians(lon - ALBERS["lon0"]) * n
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


@F.pandas_udf(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
def albers_inverse(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Degrees of projected metres: a fixed number of steps of the latitude iteration."""
    e, n, c, rho0 = _albers_constants()
    x, y = x.to_numpy(float), y.to_numpy(float)
    rho = np.hypot(x, rho0 - y)
    q = (c - (rho * n / ALBERS["a"]) ** 2) / n
    lat = np.arcsin(np.clip(q / 2, -1, 1))
    for _ in range(8):
        s = np.sin(lat)
        w = 1 - (e * s) ** 2
        lat = lat + w * w / (2 * np.cos(lat)) * (q / (1 - e * e) - s / w + np.log((1 - e * s) / (1 + e * s)) / (2 * e))
    lon = ALBERS["lon0"] + np.degrees(np.arctan2(x, rho0 - y) / n)
    return pd.DataFrame({"lon": lon, "lat": np.degrees(lat)})


def thin(points: np.ndarray, eps: float) -> np.ndarray:
    """Indexes that line simplification keeps: a farthest point stays if strictly beyond eps.

    Distance is to the segment, the first of equal maxima wins, both ends stay, and fewer than three
    points are left alone. A stack instead of recursion, so lines may have millions of points.
    """
    n = len(points)
    keep = np.ones(n, bool)
    if n < 3:
        return np.flatnonzero(keep)
    keep[1:-1] = False
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = float(d @ d)
        t = np.clip((mid - p) @ d / length, 0, 1)[:, None] if length else np.zeros((len(mid), 1))
        off = mid - (p + t * d)
        dist = np.sqrt((off * off).sum(axis=1))
        i = int(dist.argmax())
        if dist[i] > eps:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep)


def simplified(lines: DataFrame, eps: float, points: str = "pts") -> DataFrame:
    """Lines (a column array<struct<x, y>>) thinned by eps; one row a line, long lines dealt out."""
    @F.pandas_udf(POINTS)
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            r = [] if r is None else list(r)
            xy = np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2)
            out.append([r[i] for i in thin(xy, eps)])
        return pd.Series(out, dtype=object)

    return lines.withColumn(points, run(points))


def densified(segments: DataFrame, step: float) -> DataFrame:
    """Points at most ``step`` apart along segments (keys, x0, y0, x1, y1, len), each segment's end left to the next."""
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / step)).cast("int")
    keys = [c for c in segments.columns if c not in ("x0", "y0", "x1", "y1", "len")]
    rows = segments.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    t = F.col("i") / F.col("n")
    return rows.select(*keys, "i", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))
