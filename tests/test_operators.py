"""Operators on hand-made cases with known answers."""

from __future__ import annotations

import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.functions import scalar
from cinderframe.jobs import sinks
from cinderframe.operators import fires, geom, graph, raster, rings, spatial, tiles, trail, verify
from cinderframe.sources import files


def shape(spark, *rings):
    """Edges of one fire from rings of points."""
    rows = [("f", 0, i, k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, r in enumerate(rings) for k, (a, b) in enumerate(zip(r, r[1:] + r[:1]))]
    return spark.createDataFrame(rows, "id string, part int, ring int, seq int, x0 double, y0 double, x1 double, y1 double")


def grid_of(runs):
    return {(r["row"], c): r["n"] for r in runs.collect() for c in range(r["c0"], r["c1"])}


def runs_of(spark, grid):
    return spark.createDataFrame([(r, c, c + 1, n) for (r, c), n in grid.items()], "row long, c0 long, c1 long, n int")


def test_rasterise_hole_bow_tie_and_ties(spark):
    cells = lambda e: {(r["row"], c) for r in raster.rasterise(e, 2).collect() for c in range(r["c0"], r["c1"])}
    hole = shape(spark, [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 8), (8, 8), (8, 2)])
    assert cells(hole) == {(r, c) for r in range(5) for c in range(5)} - {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)}
    tie = shape(spark, [(1, 1), (5, 1), (5, 5), (1, 5)])  # edges on cell centres: low side in, high side out
    assert cells(tie) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    bow = shape(spark, [(0, 0), (8, 8), (8, 0), (0, 8)])
    assert geom.areas(bow).first()["area"] == 0 and len(cells(bow)) > 0


def test_sweep_counts_cells(spark):
    rng = random.Random(1)
    data = [(rng.randint(0, 3), a, a + rng.randint(1, 9)) for a in (rng.randint(0, 20) for _ in range(60))]
    got = grid_of(raster.sweep(spark.createDataFrame(data, "row long, c0 long, c1 long")))
    want: dict = {}
    for r, a, b in data:
        for c in range(a, b):
            want[r, c] = want.get((r, c), 0) + 1
    assert got == want


def regions(grid):
    seen, out = {}, []
    for cell in grid:
        if cell in seen:
            continue
        todo, mine = [cell], []
        seen[cell] = len(out)
        while todo:
            r, c = todo.pop()
            mine.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n not in seen and grid.get(n) == grid[cell]:
                    seen[n] = len(out)
                    todo.append(n)
        out.append(mine)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_patches_match_flood_fill(spark, seed):
    rng = random.Random(seed)
    grid = {(r, c): rng.choice([1, 1, 2]) for r in range(12) for c in range(14) if rng.random() < 0.8}
    got = sorted((p["n"], p["cells"], p["perimeter"]) for p in raster.patches(runs_of(spark, grid)).collect())
    want = []
    for m in regions(grid):
        s = set(m)
        want.append((grid[m[0]], len(m), sum(n not in s for r, c in m for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)))))
    assert got == sorted(want)


def test_sieve_by_hand(spark):
    grid = {(r, c): 1 for r in range(8) for c in range(8)}
    grid |= {(r, c): 2 for r in range(8) for c in range(8, 14)}
    grid[3, 3] = 5  # a speck in value 1
    grid[2, 13] = 3  # a speck at the border between 2 and nodata: nodata is larger
    del grid[6, 6]  # a small hole fills
    want = dict(grid)
    want[3, 3], want[6, 6] = 1, 1
    del want[2, 13]
    assert grid_of(raster.sieve(runs_of(spark, grid), 4)) == want
    clean = {(r, c): 1 + (c > 3) for r in range(4) for c in range(8)}
    assert grid_of(raster.sieve(runs_of(spark, clean), 4)) == clean


def test_chain_components(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_points_in_perimeters_match_crossings(spark):
    rng = random.Random(3)
    poly = [(100 * math.cos(i) * rng.uniform(0.5, 1), 100 * math.sin(i) * rng.uniform(0.5, 1)) for i in np.linspace(0, 6, 25)]
    hole = [(-10.0, -10.0), (-10.0, 10.0), (10.0, 10.0), (10.0, -10.0)]
    pts = [(i, rng.uniform(-110, 110), rng.uniform(-110, 110)) for i in range(300)]
    edges = [(a, b) for r in (poly, hole) for a, b in zip(r, r[1:] + r[:1])]
    want = {i for i, x, y in pts if sum(min(a[1], b[1]) <= y < max(a[1], b[1]) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= x for a, b in edges) % 2}
    p = spark.createDataFrame(pts, "pt int, x double, y double")
    for cover in ({}, {"span": 5, "dense": 3}, {"span": 1, "dense": 0}, {"span": 100}):
        got = [r["pt"] for r in spatial.in_perimeters(p, shape(spark, poly, hole), band=11, **cover).collect()]
        assert sorted(got) == sorted(want) and want, cover


def test_nearest_boundary_and_far(spark):
    e = shape(spark, [(0, 0), (10, 0), (10, 10), (0, 10)])
    p = spark.createDataFrame([(1, 13.0, 14.0), (2, 5.0, 1.0), (3, 500.0, 500.0)], "pt int, x double, y double")
    got = {r["pt"]: r["dist"] for r in spatial.nearest_boundary(p, e, 20.0).collect()}
    assert got == {1: 5.0, 2: 1.0, 3: spatial.FAR}


def test_thinning_rules():
    line = np.array([(0, 0), (1, 0.5), (2, -0.5), (3, 0), (3, 5)], float)
    kept = geom.thin(line, 0.6)
    assert kept[0] == 0 and kept[-1] == 4 and list(geom.thin(line[:2], 9)) == [0, 1]
    assert list(geom.thin(np.array([(0, 0), (1, 1), (2, 0)], float), 1.0)) == [0, 2]  # not strictly beyond
    ring = np.array([(0, 0), (4, 0), (4, 4), (0, 0)], float)
    assert list(geom.thin(ring, 0.5)) == [0, 1, 2, 3]
    rng = np.random.default_rng(1)
    walk = rng.standard_normal((5000, 2)).cumsum(0)
    kept = geom.thin(walk, 2.0)
    for a, b in zip(kept, kept[1:]):
        d, n = walk[b] - walk[a], walk[a : b + 1] - walk[a]
        t = np.clip(n @ d / max(d @ d, 1e-12), 0, 1)[:, None]
        assert np.sqrt(((n - t * d) ** 2).sum(1)).max() <= 2.0 + 1e-9


def test_albers_known_point_and_round_trip(spark):
    d = spark.createDataFrame([(-96.0, 23.0), (-120.5, 37.25), (-75.0, 35.0)], "lon double, lat double")
    x, y = geom.albers_forward(F.col("lon"), F.col("lat"))
    rows = d.select("lon", "lat", x.alias("x"), y.alias("y"), geom.albers_inverse(x, y).alias("b")).collect()
    assert abs(rows[0]["x"]) < 1e-6 and abs(rows[0]["y"]) < 1e-6
    assert abs(rows[2]["x"] - 1885472.7) < 1000 and abs(rows[2]["y"] - 1535925.0) < 1000
    assert all(abs(r["b"]["lon"] - r["lon"]) < 1e-9 and abs(r["b"]["lat"] - r["lat"]) < 1e-9 for r in rows)


def test_severity_tags(spark):
    stats = spark.createDataFrame([("a", 1, 1), ("a", 2, 7), ("b", 6, 9), ("c", 1, 1), ("c", 3, 1), ("a", 6, 100)], "id string, class int, px long")
    f = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    got = {r["id"]: (r["sev_ok"], r["sev"]) for r in fires.tag_severity(f, stats).collect()}
    assert got == {"a": (True, [12, 88, 0, 0, 0]), "b": (False, None), "c": (True, [50, 0, 50, 0, 0]), "d": (False, None)}


def test_year_totals_of_the_published_shape(spark):
    rows = [(f"WA{i}", 2000 + i % 2, None if i == 3 else 10.5, i % 3 == 0) for i in range(6)]
    got = [tuple(r) for r in fires.accumulated(fires.year_summary(spark.createDataFrame(rows, "id string, year int, acres double, sev_ok boolean"))).orderBy("year").collect()]
    assert got == [(2000, 3, 32, 1, 3, 32), (2001, 3, 21, 1, 6, 53)]


def test_landing_problems_and_objects(spark):
    d = spark.createDataFrame([(None, 200, 10**6, 1), ("u", 404, 10**6, 1), ("u", 206, 5, 1), ("u", 200, 10**6, 0), ("u", 200, 10**6, 1)], "u string, c int, s int, n int")
    got = [r[0] for r in d.select(fires.landing_problem(*(F.col(x) for x in "ucsn"))).collect()]
    assert got == ["no url", "http 404", "archive too small", "no raster inside", None]
    m = spark.createDataFrame([(1, "a", 1, "a"), (1, "a", None, None), (None, None, 1, "a"), (1, "a", 2, "a"), (1, "a", 1, "b-2"), (1, "a", 1, "b")], "s int, e string, rs int, re string")
    got = [r[0] for r in m.select(verify.object_state(*(F.col(x) for x in ("s", "e", "rs", "re")))).collect()]
    assert got == ["same", "missing", "extra", "size differs", "size only", "content differs"]


def test_reconciliation_notices_a_swap(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "year int, id string")
    b = spark.createDataFrame([(1, "x"), (1, "z")], "year int, id string")
    assert {tuple(r) for r in verify.reconciled(a, b, ["year", "id"]).collect()} == {(1, "y", "missing"), (1, "z", "extra")}


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("half"),
        scalar.whole_half_even(F.lit(2.5)).alias("even"), scalar.slug(F.lit("PCT - Oregon Section D")).alias("slug"),
        *[scalar.age_opacity(F.lit(a)).alias(f"o{a}") for a in (0, 2, 14, 40, 99)],
        scalar.count_of(F.create_map(F.lit("1"), F.lit(4)), 1).alias("k1"), scalar.count_of(F.create_map(F.lit("1"), F.lit(4)), 2).alias("k2"),
        scalar.degrees_to_metres(F.lit(1.0), F.lit(60.0)).alias("m"),
    ).first()
    assert abs(r["half"] - math.pi * scalar.EARTH_MILES) < 1e-6 and r["even"] == 2 and r["slug"] == "oregon-d" and (r["k1"], r["k2"]) == (4, 0)
    assert [round(r[f"o{a}"], 4) for a in (0, 2, 14, 40, 99)] == [0.95, 0.8, 0.625, 0.55, 0.55] and abs(r["m"] - 55660) < 1


def test_clipping_keeps_what_is_inside():
    ring = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    got = tiles.clip_ring(ring, (5, 5, 20, 20))
    assert sorted(map(tuple, got)) == [(5, 5), (5, 10), (10, 5), (10, 10)] and len(tiles.clip_ring(ring, (20, 20, 30, 30))) == 0


def test_segments_never_join(spark):
    p = spark.createDataFrame([("s", 0, 0, 0.0, 0.0), ("s", 0, 1, 0.0, 1.0), ("s", 1, 0, 50.0, 50.0)], "section string, seg int, pt int, lon double, lat double")
    total = {r["section"]: r["miles"] for r in trail.section_totals(p, ["section", "seg"]).collect()}
    assert total["s"] == total[None] == round(math.pi * scalar.EARTH_MILES / 180, 3)


def test_files_round_trip(spark, tmp_path):
    sq = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": sq}}, {"type": "Feature", "properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [sq, sq]}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(fc))
    shapes = files.multipolygons(files.features(spark, f"{tmp_path}/f.geojson")).select(F.col("properties")["id"].alias("id"), "geom")
    assert {r["id"]: len(r["geom"]) for r in shapes.collect()} == {"a": 1, "b": 2}
    sinks.geojson_lines(shapes, f"{tmp_path}/out", ["id"])
    assert {json.loads(r[0])["properties"]["id"] for r in spark.read.text(f"{tmp_path}/out").collect()} == {"a", "b"}
    pts = [("oregon-d", "Oregon & D", s, k, 42.0 + k, -120.0) for s in (0, 1) for k in range(3)]
    sinks.gpx(spark.createDataFrame(pts, "slug string, name string, seg int, pt int, lat double, lon double"), f"{tmp_path}/gpx")
    back = files.gpx_points(spark, f"{tmp_path}/gpx/*").collect()
    assert len(back) == 6 and {r["track"] for r in back} == {"Oregon & D"} and {r["seg"] for r in back} == {0, 1}
    gz = tmp_path / "gz"
    gz.mkdir()
    with gzip.open(gz / "f.geojson.gz", "wt") as f:
        json.dump(fc, f)
    assert files.features(spark, str(gz)).count() == 2
    (tmp_path / "two.gpx").write_text('<?xml version="1.0"?><gpx><trk><name>a</name><trkseg><trkpt lat="1" lon="2"/></trkseg></trk><rte><name>b</name><rtept lat="3" lon="4"/><rtept lat="5" lon="6"/></rte><trk><name>c</name><trkseg><trkpt lat="7" lon="8"/></trkseg></trk></gpx>')
    both = files.gpx_points(spark, f"{tmp_path}/two.gpx").collect()
    assert sorted((r["track"], r["seg"], r["pt"], r["lat"], r["lon"]) for r in both) == [("a", 0, 0, 1.0, 2.0), ("b", 0, 0, 3.0, 4.0), ("b", 0, 1, 5.0, 6.0), ("c", 0, 0, 7.0, 8.0)]
    (tmp_path / "stats.json").write_text('{"a": {"1": 5, "6": 2}}')
    assert {tuple(r) for r in files.severity_stats(spark, f"{tmp_path}/stats.json").collect()} == {("a", 1, 5), ("a", 6, 2)}
    (tmp_path / "m.json").write_text('{"1999": "http://x"}')
    assert files.year_manifest(spark, f"{tmp_path}/m.json").first()["year"] == 1999
    assert files.artefacts(spark, f"{tmp_path}/m.json").first()["size"] == 20
    osm = {"elements": [{"type": "relation", "id": 1, "members": [{"type": "way", "ref": 9}, {"type": "way", "ref": 8}]}, {"type": "way", "id": 9, "geometry": [{"lat": 1.0, "lon": 2.0}]}, {"type": "way", "id": 8, "geometry": []}]}
    (tmp_path / "osm.json").write_text(json.dumps(osm))
    members, ways = files.osm_elements(spark, f"{tmp_path}/osm.json")
    assert [r["ref"] for r in members.orderBy("pos").collect()] == [9, 8] and [r["id"] for r in ways.collect()] == [9]


def test_years_rebuild_and_resume(spark, tmp_path):
    sev, per = f"{tmp_path}/sev", f"{tmp_path}/per"
    years = spark.createDataFrame([(2001,), (2002,)], "year int")
    make = lambda n: lambda y: (spark.range(n).withColumn("year", F.lit(y)), spark.range(2).withColumn("year", F.lit(y)))
    assert sinks.rebuild_years(spark, years, make(3), sev, per) == [2001, 2002] and spark.read.parquet(sev).count() == 6
    assert sinks.rebuild_years(spark, years, make(3), sev, per) == []
    sinks._delete(spark, f"{per}/year=2002")
    assert sinks.rebuild_years(spark, years, make(0), sev, per) == [2002]
    assert spark.read.parquet(sev).select("year").distinct().count() == 1 and spark.read.parquet(per).count() == 4
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, px int")
    new = spark.createDataFrame([("b", 2)], "id string, px int")
    assert {tuple(r) for r in sinks.merged(old, new).collect()} == {("a", 1), ("b", 2)}


def test_steps_of_long_tracks_have_keys_of_their_own(spark):
    from cinderframe.jobs import trail_queries

    points = [(track, seg, pt, 100.0 * pt, 50.0 * track) for track, seg in ((1, 100), (2, 0), (1, 0)) for pt in range(3)]
    points += [(3, 0, pt, 5.0 * pt, 0.0) for pt in range(99, 102)] + [(3, 1, pt, 5.0 * pt, 9.0) for pt in range(3)]
    table = spark.createDataFrame(points, "track long, seg long, pt long, x double, y double")
    s = trail_queries.steps(lambda name: table).cache()
    assert s.count() == 3 * 2 * 3 + 2 + 2 == s.select("pt").distinct().count()
    square = [(0, 0, 0, 0, "f", 20.0, 40.0, 20.0, 60.0), (0, 0, 0, 1, "f", 120.0, 60.0, 120.0, 40.0)]
    edges = spark.createDataFrame(square, "part int, ring int, k int, seq int, id string, x0 double, y0 double, x1 double, y1 double")
    hits = trail_queries.spatial.in_perimeters(s, edges)
    fires = spark.createDataFrame([("f", 1)], "id string, ig_date int")
    got = {r["track"]: (r["steps"], r["burned"], r["fires"]) for r in trail_queries.trail.track_report(s.select("track", "pt"), hits, fires).collect()}
    assert got == {1: (12, 6, "f"), 2: (6, 0, ""), 3: (4, 0, "")}


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_turn_around_each_patch_and_its_holes(spark, seed):
    rng = random.Random(seed)
    grid = {(r, c): rng.choice([1, 1, 1, 2]) for r in range(10) for c in range(12) if rng.random() < 0.85}
    grid |= {(r, c + 20): 7 for r in range(5) for c in range(5) if (r, c) not in ((1, 1), (3, 3), (2, 2))}  # holes that touch at corners
    lab = raster.label_components(runs_of(spark, grid)).cache()
    comps: dict = {}
    for r in lab.collect():
        comps.setdefault(r["comp"], set()).update((r["row"], c) for c in range(r["c0"], r["c1"]))
    got: dict = {}
    for r in rings.shapes(rings.rings(lab), 1).collect():
        pts = [(int(p["x"]), int(p["y"])) for p in r["pts"]]
        turns = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(pts, pts[1:])]
        assert pts[0] == pts[-1] and all((x == 0) != (y == 0) for x, y in turns) and all((a[0] == 0) != (b[0] == 0) for a, b in zip(turns, turns[1:] + turns[:1]))
        got.setdefault(r["comp"], []).append((r["area"], sum(abs(x) + abs(y) for x, y in turns)))
    assert set(got) == set(comps)
    for comp, cells in comps.items():
        outside = {(r, c) for r in range(-1, 11) for c in range(-1, 26)} - cells
        eight = 0  # 8-connected regions around the patch: each has one ring
        left = set(outside)
        while left:
            todo = [left.pop()]
            eight += 1
            while todo:
                r, c = todo.pop()
                for n in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if n in left:
                        left.remove(n)
                        todo.append(n)
        sides = sum(n not in cells for r, c in cells for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)))
        assert sum(a for a, _ in got[comp]) == len(cells) and sum(n for _, n in got[comp]) == sides
        assert len(got[comp]) == eight and sum(a > 0 for a, _ in got[comp]) == 1


def test_causes_of_mismatches_are_the_first_that_apply(spark):
    rows = [(2, 3, 3, 3), (2, 2, 3, 3), (2, 2, 2, 3), (2, 2, 2, 2), (2, 3, 2, 2)]
    d = spark.createDataFrame(rows, "truth int, raw int, sieved int, layer int")
    assert {r["cause"]: r["n"] for r in verify.mismatch_causes(d).collect()} == {"raster": 1, "sieve": 1, "layer": 1}


def test_budget_keeps_what_a_plain_running_sum_keeps(spark):
    rng = random.Random(6)
    rows = [("severity", 2000, 2, x, 0, f"f{i}", rng.randint(0, 40), rng.randint(10, 90)) for i in range(400) for x in (0, 1)]
    d = spark.createDataFrame(rows, "layer string, year int, z int, x int, y int, id string, area int, bytes int")
    for budget in (300, 5000, 10**6):
        got = {(r["x"], r["id"]): r["own"] for r in tiles.within_budget(d, budget, salts=5).collect()}
        for x in (0, 1):
            total = 0
            for r in sorted((r for r in rows if r[3] == x), key=lambda r: (-r[6], r[5])):
                total += r[7]
                assert got[x, r[5]] == (total <= budget)
        assert len(got) == len(rows)


def test_cells_are_drawn_by_weight(spark):
    runs = spark.createDataFrame([(0, 0, 90, 2), (5, 3, 13, 3)], "row long, c0 long, c1 long, n int")
    got = spatial.weighted_cells(runs, 3000).collect()
    share = sum(r["n"] == 2 for r in got) / len(got)
    assert len(got) == 3000 and abs(share - 0.9) < 0.03 and all((r["row"], r["n"]) in ((0, 2), (5, 3)) for r in got) and {r["col"] for r in got if r["n"] == 3} == set(range(3, 13))
    fires_ = runs.withColumn("id", F.concat(F.lit("WA"), F.col("row").cast("string")))
    drawn = spatial.perimeter_cells(fires_, 2000).collect()
    assert len(drawn) == 2000 and abs(sum(r["id"] == "WA0" for r in drawn) / 2000 - 0.5) < 0.05
    assert spatial.weighted_cells(runs.limit(0), 5).count() == 0


def test_scratch_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from cinderframe.sources import scratch

    session = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/y/"}, sparkContext=SimpleNamespace(master="spark://h:7077"))
    assert scratch.scratch_dir(session) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")))


def test_largest_fire_without_its_own_ground_is_reported(spark):
    edges = shape(spark, [(0, 0), (180, 0), (180, 180), (0, 180)])
    at = spark.createDataFrame([(2000, "f", 0, 0), (2001, "g", 0, 1), (2002, "f", 5, 5)], "year int, id string, row long, col long")
    chosen = at.select("year", "id").union(spark.createDataFrame([(2003, "h")], "year int, id string"))
    mosaic = spark.createDataFrame([(2000, 0, 0, 4, 3), (2001, 0, 0, 1, 2)], "year int, row long, c0 long, c1 long, class int")
    got = {r["year"]: (r["has_perimeter"], r["has_severity"]) for r in verify.present(at, chosen, edges, mosaic, 90).collect()}
    assert got == {2000: (True, True), 2001: (False, False), 2002: (False, False), 2003: (False, False)}
