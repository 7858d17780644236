"""Rings in flat arrays against the rules for one ring."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.operators import geom, quadtree, ragged, tiles

from .test_covering import star, table


def rings_of(rng, n):
    out = [np.zeros((0, 2)), np.array([(3.0, 4.0)]), np.array([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]), np.array([(0.0, 0.0), (6.0, 6.0), (6.0, 0.0), (0.0, 6.0)])]
    out += [np.array(star(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), 10.0, rng.choice((3, 4, 30, 200)))) for _ in range(n)]
    return out + [np.round(r) for r in out[4:]]


def flat(rings):
    xy = np.concatenate(rings)
    return ragged.Rings(xy[:, 0], xy[:, 1], np.concatenate(([0], np.cumsum([len(r) for r in rings]))))


def back(r):
    return [np.stack((r.x[a:b], r.y[a:b]), axis=1) for a, b in zip(r.starts, r.starts[1:])]


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_areas_and_thinning_are_those_of_one_ring(seed):
    rng = random.Random(seed)
    rings = rings_of(rng, 25)
    r = flat(rings)
    for axis, sign in ((0, 1), (0, -1), (1, 1), (1, -1)):
        bound = np.array([float(rng.randrange(-8, 9)) for _ in rings])
        for got, one, b in zip(back(ragged.sided(r, axis, bound, sign)), rings, bound):
            want = quadtree.cut(one, axis, b, sign) if len(one) else one
            if len(want) > 2 or len(got) > 2:
                assert got.tolist() == want.tolist()
    assert r.areas().tolist() == [pytest.approx(quadtree.signed_area(x) if len(x) > 2 else 0.0) for x in rings]
    closed = ragged.closed(r)
    eps = np.array([rng.choice((0.1, 1.0, 3.0)) for _ in rings])
    keep = ragged.thinned(closed, eps)
    for a, b, one, e in zip(closed.starts, closed.starts[1:], rings, eps):
        line = np.concatenate((one, one[:1]))
        assert np.flatnonzero(keep[a:b]).tolist() == (geom.thin(line, e).tolist() if len(line) > 1 else list(range(len(line))))


def test_pieces_in_blocks_add_up_however_few_points_are_held(monkeypatch):
    rng = random.Random(3)
    r = flat(rings_of(rng, 20))
    want = r.areas()
    for held in (10, 500, 2_000_000):
        monkeypatch.setattr(tiles, "POINTS_HELD", held)
        for size in (1.5, 7.0, 1000.0):
            assert np.abs(tiles.blocks_areas(r, size) - want).max() < 1e-9


def test_cut_areas_and_thinned_sums_send_no_ring_twice(spark):
    rng = random.Random(7)
    e = table(spark, [(f"f{i}", star(rng, 0.0, 0.0, 9000.0, 40)) for i in range(20)])
    rings = geom.open_rings(e)
    areas = {r["id"]: r["area"] for r in tiles.cut_areas(rings, 500.0).collect()}
    want = {r["id"]: abs(r["area"]) for r in geom.areas(e).collect()}
    assert areas.keys() == want.keys() and all(math.isclose(areas[k], want[k], rel_tol=1e-9) for k in want)
    zs = rings.withColumn("zs", F.array(F.lit(2), F.lit(5))).withColumn("eps", F.array(F.lit(2000.0), F.lit(100.0)))
    lines = [[(p["x"], p["y"]) for p in r["pts"]] for r in geom.closed_rings(e).collect()]
    got = {r["z"]: (r["n"], r["m"]) for r in tiles.thinned_sums(zs).collect()}
    assert got == {z: (20 * 41, sum(len(geom.thin(np.array(x), eps)) for x in lines)) for z, eps in ((2, 2000.0), (5, 100.0))}


def test_features_are_those_of_the_pieces_of_all_zooms(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(30):
        turn = np.sort(rng.random(40)) * 2 * np.pi
        far = 0.3 + rng.random(40) * (30.0 if i == 0 else 0.02 if i % 3 else 0.4)
        rows.append((f"f{i}", 0, 0, (-120 + i / 50 + far * np.cos(turn)).tolist(), (40 + far * np.sin(turn)).tolist()))
        rows.append((f"f{i}", 0, 1, [-120.01, -120.01, -119.99], [40.0, 40.01, 40.0]))
    rings = spark.createDataFrame(rows, "id string, part int, ring int, xs array<double>, ys array<double>")
    pieces = quadtree.quadtree(rings, (2, 9), 3)
    want = {(r["id"], r["z"], r["x"], r["y"]): r for r in quadtree.tile_features(pieces).collect()}
    points = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    for held in (50, 200_000):
        monkeypatch.setattr(quadtree, "HELD", held)
        got = {(r["id"], r["z"], r["x"], r["y"]): r for r in quadtree.features(rings.withColumn("m2", F.abs(geom.ring_area(points))), (2, 9), 0.0).collect()}
        assert got.keys() == want.keys() and len(want) > 1000
        for k, w in want.items():
            assert got[k]["area"] == pytest.approx(w["area"], abs=1e-9) and got[k]["bytes"] == w["bytes"] and got[k]["geom"] == w["geom"], k
    whole = {r["id"]: abs(r["area"]) for r in rings.where("ring = 0").withColumn("area", geom.ring_area(points)).collect()}
    hole = {r["id"]: abs(r["area"]) for r in rings.where("ring = 1").withColumn("area", geom.ring_area(points)).collect()}
    few = {(r["id"], r["z"]) for r in quadtree.features(rings.withColumn("m2", F.abs(geom.ring_area(points))), (2, 9), 50.0).select("id", "z").collect()}
    seen = {(k[0], k[1]) for k in want if k[1] == 9 or whole[k[0]] - hole[k[0]] >= (360.0 / 2.0 ** k[1] / 4096 * 50.0) ** 2}
    assert few == seen and seen != {k[:2] for k in want}
