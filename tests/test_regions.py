"""Regions, rings, the repeat product and tile pieces against direct walks over small grids."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.operators import geom, labels, product, quadtree, raster, rings


def cells_of(spark, grid):
    rows = [(r, c, c + 1, n) for (r, c), n in sorted(grid.items())]
    return spark.createDataFrame(rows, "row long, c0 long, c1 long, n int")


def flood(grid):
    """{cell: first cell of its region of equal n}."""
    left, out = set(grid), {}
    for s in sorted(grid):
        if s in left:
            left.discard(s)
            todo, own = [s], [s]
            while todo:
                r, c = todo.pop()
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if q in left and grid[q] == grid[s]:
                        left.discard(q)
                        todo.append(q)
                        own.append(q)
            out |= dict.fromkeys(own, s)
    return out


def labelled(lab):
    return {(r["row"], c): r["comp"] for r in lab.collect() for c in range(r["c0"], r["c1"])}


@pytest.fixture(scope="module")
def speckled():
    rng = random.Random(11)
    return {(r, c): rng.choice([1, 1, 1, 2]) for r in range(-9, 13) for c in range(-7, 14) if rng.random() < 0.85}


@pytest.mark.parametrize(("block", "most"), [(4, 10_000), (5, 40)])
def test_regions_and_rings_for_any_blocks(spark, speckled, block, most):
    """Few links or paths a task: the others go through contraction on the cluster."""
    lab = labels.label_components(cells_of(spark, speckled), block, most).cache()
    got = labelled(lab)
    assert got == {k: r * labels.ROW + c for k, (r, c) in flood(speckled).items()}
    area, around = Counter(), Counter()
    for r in rings.shapes(rings.rings(lab, block, most), 1).collect():
        pts = [(int(p["x"]), int(p["y"])) for p in r["pts"]]
        steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(pts, pts[1:])]
        assert all((x == 0) != (y == 0) for x, y in steps) and all((a[0] == 0) != (b[0] == 0) for a, b in zip(steps, steps[1:] + steps[:1]))
        area[r["comp"]] += r["area"]
        around[r["comp"]] += sum(abs(x) + abs(y) for x, y in steps)
    assert area == Counter(got.values())
    assert around == Counter(k for (r, c), k in got.items() for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if got.get(q) != k)


def test_one_snake_over_many_blocks_is_one_region_and_one_ring(spark):
    """A spiral of 250,000 cells, whose outline has half a million sides, over 64 blocks."""
    n = 1000
    rows = []
    for r in range(0, n, 2):
        rows.append((r, 0, 500, 1))
        rows.append((r + 1, 499, 500, 1) if (r // 2) % 2 == 0 else (r + 1, 0, 1, 1))
    runs = spark.createDataFrame(rows, "row long, c0 long, c1 long, n int")
    lab = labels.label_components(runs, 128).cache()
    assert [r["comp"] for r in lab.select("comp").distinct().collect()] == [0]
    shape = rings.shapes(rings.rings(lab, 128), 1).select("area", F.size("pts").alias("k")).collect()
    # each of the 499 turns has four corners, as have the first row's start and the last turn's end
    assert [r["area"] for r in shape] == [500 * 500 + 500] and abs(shape[0]["k"] - 4 * 500) <= 6


def test_forest_finds_the_least_node_of_each_tree():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (400, 500)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert labels.forest(n, a, b).tolist() == want
    chain = np.arange(200_000)
    assert (labels.forest(200_001, chain, chain + 1) == 0).all()


def test_product_of_a_small_grid(spark):
    grid = {(r, c): 1 for r in range(20) for c in range(20)}
    grid |= {(r, c): 3 for r in range(4, 12) for c in range(4, 12)}
    grid |= {(7, 7): 1, (15, 15): 2}  # specks: a hole in the patch, and a lone cell
    got = product.repeat_patches(cells_of(spark, grid)).collect()
    assert [(r["count"], r["acres"], len(r["geom"]), len(r["geom"][0])) for r in got] == [(3, round(64 * 8100 / 4046.86), 1, 1)]
    ring = [(p["x"], p["y"]) for p in got[0]["geom"][0][0]]
    assert ring[0] == ring[-1] and len(ring) == 5 and all(round(v, 4) == v for p in ring for v in p)
    corners = spark.createDataFrame([(4 * 90.0, 4 * 90.0), (12 * 90.0, 12 * 90.0)], "x double, y double")
    d = [r["d"] for r in corners.select(geom.albers_inverse("x", "y").alias("d")).collect()]
    assert min(p[0] for p in ring) == pytest.approx(d[0]["lon"], abs=1e-4) and max(p[1] for p in ring) == pytest.approx(d[1]["lat"], abs=1e-4)
    rough = product.repeat_patches(cells_of(spark, grid), 1, 45.0).collect()  # finer than a cell's diagonal: the hole stays
    assert sorted((r["count"], r["acres"], len(r["geom"][0])) for r in rough) == [(2, 2, 1), (3, round(63 * 8100 / 4046.86), 2)]
    assert product.repeat_patches(cells_of(spark, {(0, 0): 1})).count() == 0


def test_pieces_lie_in_their_tiles_and_keep_the_area(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        turn = np.sort(rng.random(40)) * 2 * np.pi
        far = 0.3 + rng.random(40) * (3.0 if i == 0 else 0.4)
        rows.append((f"f{i}", 0, 0, (-120 + far * np.cos(turn)).tolist(), (40 + far * np.sin(turn)).tolist()))
    rows.append(("f1", 0, 1, [-120.01, -120.01, -119.99], [40.0, 40.01, 40.0]))
    schema = "id string, part int, ring int, xs array<double>, ys array<double>"
    got = quadtree.quadtree(spark.createDataFrame(rows, schema), (2, 9), 3).toPandas()
    whole = {(i, p, r): quadtree.signed_area(np.stack((x, y), axis=1)) for i, p, r, x, y in rows}
    for r in got.itertuples():
        assert quadtree.west(r.x, r.z) - 1e-9 <= min(r.xs) and max(r.xs) <= quadtree.west(r.x + 1, r.z) + 1e-9
        assert quadtree.north(r.y + 1, r.z) - 1e-9 <= min(r.ys) and max(r.ys) <= quadtree.north(r.y, r.z) + 1e-9
    for (i, part, ring, _), a in got.groupby(["id", "part", "ring", "z"])["area"].sum().items():
        assert a == pytest.approx(whole[i, part, ring], abs=1e-9)
    assert set(got["z"]) == set(range(2, 10))
    f = quadtree.tile_features(spark.createDataFrame(got)).where("id = 'f1' and z = 2").collect()
    assert sum(r["area"] for r in f) == pytest.approx(abs(whole["f1", 0, 0]) - abs(whole["f1", 0, 1]), abs=1e-9)
    assert all(0 <= v <= quadtree.EXTENT for r in f for g in r["geom"] for v in g["px"])


def test_a_tile_of_very_many_features_is_many_rows_in_order(spark):
    """100,000 overlapping fires on one tile of zoom 2, among them a year of half of all."""
    year = F.when(F.col("i") % 2 == 0, 2000).otherwise(1984 + F.col("i") % 40).cast("int").alias("fire_year")
    base = spark.range(100_000).withColumnRenamed("id", "i").select(F.col("i").cast("string").alias("id"), year, F.lit(100).cast("long").alias("bytes"))
    place = [F.lit("perimeters").alias("layer"), F.lit(0).alias("year"), F.lit(2).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(1).cast("long").alias("y")]
    rows = quadtree.tile_rows(base.select(*place, "*"), 500_000)
    got = rows.select("row", F.size("features").alias("n"), F.col("features")[0]["fire_year"].alias("a"), F.element_at("features", -1)["fire_year"].alias("z")).orderBy("row").collect()
    assert sum(r["n"] for r in got) == 100_000 and len(got) >= 15 and max(r["n"] for r in got) <= 2 * 5_000
    assert all(r["a"] <= r["z"] for r in got) and all(p["z"] <= q["a"] for p, q in zip(got, got[1:]))
    assert rows.select(F.explode("features.id")).distinct().count() == 100_000


def test_geometry_is_looked_for_in_the_stored_layer(spark, tmp_path):
    """A layer that lacks one fire, and holds another one's outline under its tile, fails for that fire alone."""
    square = lambda x, y, r: ([x - r, x + r, x + r, x - r], [y - r, y - r, y + r, y + r])
    rows = [("a", 0, 0, *square(-120.0, 40.0, 0.01)), ("b", 0, 0, *square(-120.0, 40.0, 0.02)), ("c", 0, 0, *square(-110.0, 41.0, 0.005)), ("c", 0, 1, *square(-110.0, 41.0, 0.001))]
    pieces = quadtree.on_tiles(spark.createDataFrame(rows, "id string, part int, ring int, xs array<double>, ys array<double>"), 13)
    f = quadtree.tile_features(pieces).where("id <> 'a'").select(F.lit("perimeters").alias("layer"), F.lit(0).alias("year"), "z", "x", "y", "id", F.lit(1999).alias("fire_year"), "geom", "bytes")
    quadtree.tile_rows(f).write.partitionBy("layer", "year", "z").parquet(f"{tmp_path}/layer")
    points = spark.createDataFrame([("a", -120.0, 40.0), ("b", -120.0, 40.0), ("c", -110.003, 41.0), ("d", 0.0, 0.0)], "id string, lon double, lat double")
    stored = spark.read.parquet(f"{tmp_path}/layer")
    assert {r["id"]: r["found"] for r in quadtree.has_geometry(stored, points, 13).collect()} == {"a": False, "b": True, "c": True, "d": False}
    hole = spark.createDataFrame([("c", -110.0, 41.0)], "id string, lon double, lat double")
    assert not quadtree.has_geometry(stored, hole, 13).first()["found"]
