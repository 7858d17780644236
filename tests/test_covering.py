"""Coverings of perimeters against crossing counts and the cells' own ground."""

from __future__ import annotations

import math
import random

from cinderframe.operators import covering, spatial

EDGE = "id string, part int, ring int, seq int, x0 double, y0 double, x1 double, y1 double"


def table(spark, rings):
    """Edges of rings (id, points)."""
    return spark.createDataFrame([(i, 0, k, s, *a, *b) for k, (i, r) in enumerate(rings) for s, (a, b) in enumerate(zip(r, r[1:] + r[:1]))], EDGE)


def inside(rings, fire, x, y):
    edges = [(a, b) for i, r in rings if i == fire for a, b in zip(r, r[1:] + r[:1])]
    return sum(min(a[1], b[1]) <= y < max(a[1], b[1]) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= x for a, b in edges) % 2 == 1


def star(rng, cx, cy, r, n):
    return [(cx + r * rng.uniform(0.6, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.6, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_cells_lie_inside_or_meet_edges_and_leave_nothing_out(spark):
    rng = random.Random(8)
    rings = [("big", star(rng, 40000.0, -30000.0, 60000.0, 900)), ("big", star(rng, 40000.0, -30000.0, 9000.0, 40)), ("small", star(rng, 300.0, 500.0, 90.0, 7))]
    rings += [("box", [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]), ("flat", [(5.0, 5.0), (9.0, 5.0), (5.0, 5.0)])]
    edges = table(spark, rings)
    cells = covering.covering(edges, dense=20).collect()
    assert len({r["lv"] for r in cells if r["id"] == "big"}) > 1  # dense cells were cut
    for fire in ("big", "small", "box", "flat"):
        mine = {(r["lv"], r["gx"], r["gy"]): r["inside"] for r in cells if r["id"] == fire}
        assert len(mine) == sum(r["id"] == fire for r in cells) < 60000
        sizes = {lv for lv, _, _ in mine}
        x, y = zip(*[p for i, r in rings if i == fire for p in r])
        tries = [(rng.uniform(min(x) - 9, max(x) + 9), rng.uniform(min(y) - 9, max(y) + 9)) for _ in range(400)] + list(zip(x, y))[:50]
        for px, py in tries:
            held = [mine[k] for lv in sizes if (k := (lv, math.floor(px / 2**lv), math.floor(py / 2**lv))) in mine]
            assert len(held) <= 1
            if held != [False]:
                assert inside(rings, fire, px, py) == (held == [True]), (fire, px, py)


def test_points_on_cell_lines_and_vertices_are_answered_by_the_half_open_rule(spark):
    rings = [("box", [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]), ("in", [(16.0, 16.0), (16.0, 48.0), (48.0, 48.0), (48.0, 16.0)]), ("tilt", [(8.0, 0.0), (56.0, 32.0), (8.0, 64.0)])]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(-4, 69, 4) for y in range(-4, 69, 4))]
    p = spark.createDataFrame(pts, "pt int, x double, y double")
    want = sorted((i, f) for i, x, y in pts for f in ("box", "in", "tilt") if inside(rings, f, x, y))
    for span in (2, 16):
        assert sorted(map(tuple, spatial.in_perimeters(p, table(spark, rings), span=span).collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], EDGE)
    p = spark.createDataFrame([(1, 1.0, 2.0)], "pt int, x double, y double")
    assert covering.covering(none).count() == 0 and spatial.in_perimeters(p, none).count() == 0
    assert spatial.in_perimeters(p.limit(0), table(spark, [("a", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)])])).count() == 0
