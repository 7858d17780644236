"""Queries over geometry, burn counts, zonal histograms, components and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions import scalar
from cinderframe.jobs.common import REC_CELLS, REC_EDGES, RECORD, fx, register
from cinderframe.operators import fires as fi
from cinderframe.operators import geom, increments, product, raster, rings, spatial, squares, verify
from cinderframe.jobs import sinks
from cinderframe.sources.scratch import fresh_path, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

EDGES = f"{fx('fx_edges')}, {RECORD}, {REC_EDGES}"
CELLS = f"{EDGES}, {REC_CELLS}"
COUNTS = f"{CELLS}, counts as (select row, col, count(*) as n from cells group by 1, 2)"
#: Regions of equal count by flood fill over runs: not how the operators work.
REGIONS = f"""{COUNTS.replace('with ', 'with recursive ', 1)}, isl as (select row, col, n, col - row_number() over (partition by row, n order by col) as g from counts),
r as (select row * 10000000 + min(col) as id, row, n, min(col) as c0, max(col) + 1 as c1 from isl group by row, n, g),
l as (select a.id as a, b.id as b from r a join r b on b.row = a.row + 1 and b.n = a.n and a.c0 < b.c1 and b.c0 < a.c1), e as (select a, b from l union all select b, a from l),
lab(id, root) using key (id) as (select id, id from r union select e.b, min(f.root) from lab f join e on e.a = f.id join recurring.lab x on x.id = e.b where f.root < x.root group by e.b),
reg as (select root, n, cast(sum(c1 - c0) as bigint) as cells from r join lab using (id) group by 1, 2)"""
#: At each corner of the grid, how many of its four cells have a count, and whether two of them face each other.
CORNERS = f"""{COUNTS}, q as (select n, row + dr as y, col + dc as x, (dr + dc) % 2 as side from counts, (values (0), (1)) a(dr), (values (0), (1)) b(dc) where n >= 2),
k as (select n, x, y, count(*) as k, count(*) = 2 and sum(side) <> 1 as facing from q group by 1, 2, 3)"""
#: True containment by counting crossings of every edge.
INSIDE = "inside as (select p.pt, e.id from fx_points p join rec_edges e on least(e.y0,e.y1) <= p.y and p.y < greatest(e.y0,e.y1) and e.x0 + (p.y-e.y0)*1e0*(e.x1-e.x0)/(e.y1-e.y0) <= p.x group by 1, 2 having count(*) % 2 = 1)"
BOX = "b as (select id, min(least(x0,x1)) as xmin, min(least(y0,y1)) as ymin, max(greatest(x0,x1)) as xmax, max(greatest(y0,y1)) as ymax from rec_edges group by id)"


@query("geo12_edges", f"{EDGES} select id, part, ring, seq, x0*1e0 as x0, y0*1e0 as y0, x1*1e0 as x1, y1*1e0 as y1 from rec_edges")
def geo12(t):
    """Nested geometry exploded to edges."""
    return geom.edges_of(geom.nest(t.edges()))


@query("geo2_envelopes", f"{EDGES}, {BOX} select id, xmin, ymin, xmax, ymax, cast(floor(xmin/90e0)-1 as bigint) as c_from, cast(floor(ymin/90e0)-1 as bigint) as r_from, cast(floor(xmax/90e0)+1 as bigint) as c_to, cast(floor(ymax/90e0)+1 as bigint) as r_to from b")
def geo2(t):
    boxes = geom.envelopes(t.edges())
    return boxes.join(geom.pixel_window(boxes, 90), "id")


@query("geo3_snapped_extent", f"{EDGES}, {BOX} select cast(floor(min(xmin)/90e0)*90 as bigint) as xmin, cast(floor(min(ymin)/90e0)*90 as bigint) as ymin, cast(ceil(max(xmax)/90e0)*90 as bigint) as xmax, cast(ceil(max(ymax)/90e0)*90 as bigint) as ymax from b")
def geo3(t):
    return geom.snapped_extent(t.edges(), 90)


@query("geo5_polygon_area", f"{EDGES}, a as (select id, part, ring, abs(sum(x0*y1-x1*y0))/2e0 as a from rec_edges group by 1, 2, 3) select id, sum(case when ring = 0 then a else -a end) as area from a group by id")
def geo5(t):
    return geom.areas(t.edges())


@query("geo11_repaired", f"{EDGES} select id, cast(count(distinct part) as int) as parts, cast(count(*) + count(distinct part*100+ring) as int) as points from rec_edges group by id")
def geo11(t):
    """Opened rings and stray ones repaired: closed again, the strays gone."""
    stray = F.array(F.array(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))))
    opened = F.transform("geom", lambda p: F.transform(p, lambda r: F.slice(r, 1, F.size(r) - 1)))
    fixed = geom.nest(t.edges()).select("id", geom.repair(F.concat(opened, stray)).alias("geom"))
    return fixed.select("id", F.size("geom").alias("parts"), F.size(F.flatten(F.flatten("geom"))).alias("points"))


@query("geo4_rasterised", f"{CELLS} select id, row, count(*) as cells, min(col) as c_min, max(col) as c_max from cells group by 1, 2")
def geo4(t):
    return t.runs().groupBy("id", "row").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"), F.min("c0").alias("c_min"), (F.max("c1") - 1).alias("c_max"))


@query("agg4_burn_count", f"{COUNTS} select row, cast(n as int) as n, count(*) as cells, min(col) as c_min, max(col) as c_max from counts group by 1, 2")
def agg4(t):
    """How many fires burned each cell, per row and count."""
    return raster.sweep(t.runs()).groupBy("row", "n").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"), F.min("c0").alias("c_min"), (F.max("c1") - 1).alias("c_max"))


@query("agg4_changed_counts", f"{CELLS}, counts as (select row, col, count(*) as n from cells join rec using (id) where year <> 1997 group by 1, 2) select row, cast(n as int) as n, count(*) as cells, min(col) as c_min, max(col) as c_max from counts group by 1, 2")
def agg4_changed(t):
    """Burn counts built up year by year and one year taken out again, by bands of rows that the years meet."""
    path, runs = fresh_path(t.spark, "counts"), written(t.runs().join(t.record().select("id", "year"), "id"), "year-runs")
    increments.change(runs.where("year <= 1998"), path)
    increments.change(runs.where("year = 1999"), path)
    increments.change(runs.where("year = 1997"), path, -1)
    increments.change(runs.where("year >= 2000"), path)
    found = increments.counts(t.spark, path)
    return found.groupBy("row", "n").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"), F.min("c0").alias("c_min"), (F.max("c1") - 1).alias("c_max"))


@query("agg5_acres_per_count", f"{REGIONS} select cast(n as int) as n, count(*) as patches, cast(sum(cells) as bigint) as cells, cast(round(sum(cells)*8100/4046.86e0) as bigint) as acres from reg group by 1")
def agg5(t):
    """Patches, cells and acres of each burn count."""
    return raster.patches_per_count(raster.label_components(raster.sweep(t.runs())))


@query("flt6_reburned_cells", f"{COUNTS} select cast(n as int) as n, count(*) as cells from counts where n >= 2 group by 1")
def flt6(t):
    return raster.cells("n", raster.sweep(t.runs()).where("n >= 2"))


@query("win3_acres_at_levels", f"{COUNTS} select cast(l.n as int) as level, count(*) as cells, cast(round(count(*)*8100/4046.86e0) as bigint) as acres from (select distinct n from counts) l join counts c on c.n >= l.n group by 1")
def win3(t):
    return raster.acres_at_levels(raster.sweep(t.runs()))


@query("agg6_burned_shares", f"{COUNTS} select cast(least(n, 4) as int) as times, count(*) as cells, round(count(*) / (select count(*) from counts), 6) as share from counts group by 1")
def agg6(t):
    return raster.burned_shares(raster.sweep(t.runs()))


@query("agg7_conservation", f"{CELLS}, a as (select id, count(*) * 8100 as m2 from cells group by id), s as (select id, part, ring, abs(sum(x0*y1-x1*y0))/2e0 as a from rec_edges group by 1, 2, 3), p as (select id, sum(case when ring = 0 then a else -a end) as area from s group by id) select count(*) as fires, cast(sum(coalesce(m2, 0)) as bigint) as counted, sum(area) as drawn, round(100e0 * (sum(coalesce(m2, 0)) - sum(area)) / sum(area), 6) as off, count(*) filter (area = 0) as selfcrossing from p left join a using (id)")
def agg7(t):
    """Counted ground against drawn ground; fires whose signed area vanishes are told apart."""
    counted = raster.cells("id", t.runs()).select("id", (F.col("cells") * 8100).alias("m2"))
    rows = geom.areas(t.edges()).join(counted, "id", "left").withColumn("m2", F.coalesce("m2", F.lit(0)))
    return rows.agg(F.count("*").alias("fires"), F.sum("m2").cast("long").alias("counted"), F.sum("area").alias("drawn"), F.round(100 * (F.sum("m2") - F.sum("area")) / F.sum("area"), 6).alias("off"), F.count_if(F.col("area") == 0).alias("selfcrossing"))


@query("agg17_prescribed_share", f"""{CELLS}, k as (select row, col, count(*) as n, count(*) filter (type = 'Prescribed Fire') as p from cells join rec using (id) group by 1, 2)
select count(*) as cells, count(*) filter (p >= 1) as any_prescribed, count(*) filter (p >= 2) as two_prescribed from k where n >= 2""")
def agg17(t):
    runs = t.runs().join(t.record().select("id", (F.col("type") == "Prescribed Fire").alias("pre")), "id")
    length = F.col("c1") - F.col("c0")
    k = raster.sweep(runs, p=F.col("pre")).where("n >= 2")
    return k.agg(F.sum(length).alias("cells"), F.sum(F.when(F.col("p") >= 1, length).otherwise(0)).alias("any_prescribed"), F.sum(F.when(F.col("p") >= 2, length).otherwise(0)).alias("two_prescribed"))


@query("agg19_deepest_cells", f"""{COUNTS}, top as (select row, col, n from counts where n = (select max(n) from counts))
select t.row, t.col, cast(t.n as int) as n, min(r.year) as first_year, max(r.year) as last_year from top t join cells c on c.row = t.row and c.col = t.col join rec r on r.id = c.id group by 1, 2, 3""")
def agg19(t):
    """The cells burned most often, with the years of their first and last fire."""
    runs = t.runs()
    counts = written(raster.sweep(runs), "burn-counts")
    most = F.broadcast(counts.agg(F.max("n").alias("most")))
    top = counts.join(most).where("n = most").select("row", "n", "c0", "c1")
    held = raster.overlap(top, runs.join(t.record().select("id", "year"), "id"), ["row"]).withColumn("col", F.explode(F.sequence("c0", F.col("c1") - 1)))
    return held.groupBy("row", "col", "n").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("agg2_class_histogram", f"{CELLS}, mosaic as ({{mosaic}}) select c.id, m.class, count(*) as px from cells c join rec r using (id) join mosaic m on m.year = r.year and m.row = c.row and m.c0 = c.col - c.col % 4 where m.class between 1 and 6 group by 1, 2")
def agg2(t):
    """Cells of each severity class inside each fire, by overlapping runs (JN4)."""
    runs = t.runs().join(t.record().select("id", "year"), "id")
    return raster.zonal_histogram(runs, t("fx_mosaic"))


@query("agg18_unburned_share", f"{CELLS}, mosaic as ({{mosaic}}) select r.year, count(*) as px, round(count(*) filter (class = 1) / count(*), 6) as share from cells c join rec r using (id) join mosaic m on m.year = r.year and m.row = c.row and m.c0 = c.col - c.col % 4 where m.class between 1 and 6 group by 1")
def agg18(t):
    """Share of in-perimeter cells classed unburned to low, by year."""
    year = t.record().select("id", "year")
    h = raster.zonal_histogram(t.runs().join(year, "id"), t("fx_mosaic")).join(year, "id")
    return h.groupBy("year").agg(F.sum("px").alias("px"), F.round(F.sum(F.when(F.col("class") == 1, F.col("px")).otherwise(0)) / F.sum("px"), 6).alias("share"))


@query("jn13_clipped_mosaic", f"{CELLS}, mosaic as ({{mosaic}}), wa as (select distinct row, col from cells where substr(id, 1, 2) = 'WA') select m.year, m.class, count(*) as cells from mosaic m join wa on m.row = wa.row and m.c0 <= wa.col and wa.col < m.c1 group by 1, 2")
def jn13(t):
    """The mosaic clipped to one state's burned ground."""
    ground = raster.sweep(t.runs().where(scalar.state(F.col("id")) == "WA"))
    return raster.clip(t("fx_mosaic"), ground).groupBy("year", "class").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"))


@query("jn2_point_in_perimeter", f"{fx('fx_edges', 'fx_points')}, {RECORD}, {REC_EDGES}, {INSIDE} select pt, id from inside")
def jn2(t):
    return spatial.inside_lists(t("fx_points"), t.edges()).select(F.explode("pts").alias("pt"), "id")


@query("jn3_grid_candidates", f"{fx('fx_edges', 'fx_points')}, {RECORD}, {REC_EDGES}, {BOX} select p.pt, b.id from fx_points p join b on p.x between xmin and xmax and p.y between ymin and ymax")
def jn3(t):
    return spatial.box_lists(t("fx_points"), geom.envelopes(t.edges())).select(F.explode("pts").alias("pt"), "id")


@query("jn14_value_at_points", f"{COUNTS}, pts as ({{points}}) select p.pt, cast(coalesce(c.n, -1) as int) as n from pts p left join counts c on c.row = cast(floor(p.y/90e0) as bigint) and c.col = cast(floor(p.x/90e0) as bigint)")
def jn14(t):
    """The burn count at points, -1 outside the raster."""
    found = spatial.at_points(t("fx_points"), raster.sweep(t.runs()), raster.CELL)
    return found.select("pt", F.coalesce("n", F.lit(-1)).alias("n"))


@query("jn5_count_or_one", f"{COUNTS}, pts as ({{points}}) select p.pt, cast(coalesce(c.n, 1) as int) as n from pts p left join (select * from counts where n >= 2) c on c.row = cast(floor(p.y/90e0) as bigint) and c.col = cast(floor(p.x/90e0) as bigint)")
def jn5(t):
    """Repeat count at points; ground outside every patch counts one."""
    found = spatial.at_points(t("fx_points"), raster.sweep(t.runs()).where("n >= 2"), raster.CELL)
    return found.select("pt", F.coalesce("n", F.lit(1)).alias("n"))


DIST = """e2 as (select *, cast(x1-x0 as double) as dx, cast(y1-y0 as double) as dy from rec_edges),
near as (select pt, min(d) as d from (select p.pt, sqrt(power(p.x-(x0+tt*dx), 2)+power(p.y-(y0+tt*dy), 2)) as d from (select p.pt, p.x, p.y, e.*,
  least(1e0, greatest(0e0, ((p.x-x0)*dx+(p.y-y0)*dy)/(dx*dx+dy*dy))) as tt from fx_points p join e2 e
  on least(x0,x1) - 600 <= p.x and p.x <= greatest(x0,x1) + 600 and least(y0,y1) - 600 <= p.y and p.y <= greatest(y0,y1) + 600) p) where d <= 600 group by pt)"""


@query("jn6_nearest_boundary", f"{fx('fx_edges', 'fx_points')}, {RECORD}, {REC_EDGES}, {DIST} select p.pt, round(coalesce(n.d, 1e12), 3) as dist from fx_points p left join near n using (pt)")
def jn6(t):
    return spatial.nearest_boundary(t("fx_points"), t.edges(), 600.0).select("pt", F.round("dist", 3).alias("dist"))


CHECK = f"{COUNTS}, fx_points as ({{points}}), {INSIDE}, {DIST}, truth as (select pt, count(*) as want from inside group by pt), chk as (select p.pt, coalesce(c.n, 0) as got, coalesce(t.want, 0) as want, coalesce(d.d, 1e12) as dist from fx_points p left join counts c on c.row = cast(floor(p.y/90e0) as bigint) and c.col = cast(floor(p.x/90e0) as bigint) left join truth t on t.pt = p.pt left join near d on d.pt = p.pt)"


def checked(t):
    """(pt, got, want, dist): the raster's count against exact containment at each sample point."""
    points, edges = t("fx_points"), written(t.edges(), "edges")
    counts = written(squares.burn_counts(edges, raster.CELL), "counts")
    got = spatial.at_points(points, counts, raster.CELL).select("pt", F.coalesce("n", F.lit(0)).alias("got"))
    want = spatial.perimeter_counts(points, edges).withColumnRenamed("n", "want")
    dist = spatial.nearest_boundary(points, edges, 600.0)
    return got.join(want, "pt", "left").join(dist, "pt").select("pt", "got", F.coalesce("want", F.lit(0)).alias("want"), "dist")


@query("agg12_agreement_by_band", f"{CHECK} select case when dist < 130 then 'under 130' when dist < 500 then '130 to 500' else '500 and over' end as band, count(*) as n, count(*) filter (got = want) as ok from chk group by rollup(1)")
def agg12(t):
    return verify.agreement(checked(t))


@query("agg13_mismatch_sizes", f"{CHECK} select cast(got - want as bigint) as off, count(*) as n from chk where got <> want group by 1")
def agg13(t):
    return verify.mismatch_sizes(checked(t))


@query("agg14_mismatch_causes")
def agg14(t):
    """Where the simplified patches of the sieved raster disagree with the truth on burned ground, and which step did it.

    Ground outside every patch of two fires or more counts one, as in the product.
    """
    points, edges = t("fx_points"), written(t.edges(), "edges")
    counts = written(squares.burn_counts(edges, raster.CELL), "counts")
    sieved = written(raster.sieve(counts, 16), "sieved")
    layer = patch_layer(sieved.where("n >= 2"), raster.CELL)
    truth = spatial.perimeter_counts(points, edges).withColumnRenamed("n", "truth")
    rows = truth
    for name, runs in (("raw", counts), ("sieved", sieved), ("layer", layer)):
        found = spatial.at_points(points, runs.where("n >= 2"), raster.CELL).groupBy("pt").agg(F.coalesce(F.max("n"), F.lit(1)).alias(name))
        rows = rows.join(found, "pt")
    return verify.mismatch_causes(rows)


def patch_layer(runs, cell: int):
    """(row, c0, c1, n): patches of equal count as polygons thinned by a cell, put back on the raster."""
    lab = written(raster.label_components(runs), "layer-labels")
    shape = rings.shapes(rings.rings(lab), cell).select("comp", "ring", "pts")
    thin = geom.simplified(shape.repartition("comp", "ring"), float(cell)).where("size(pts) >= 4")
    edge = thin.select(F.col("comp").alias("id"), F.posexplode(F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b"))).alias("seq", "e"))
    edge = edge.select("id", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1")).where("x0 <> x1 or y0 <> y1")
    return raster.rasterise(edge, cell).join(lab.select(F.col("comp").alias("id"), "n").distinct(), "id").select("row", "c0", "c1", "n")


@query("geo6_point_edge_distance", f"{fx('fx_edges', 'fx_points')}, {RECORD}, {REC_EDGES}, {DIST} select count(*) as n, round(min(d), 3) as least, round(max(d), 3) as most from near")
def geo6(t):
    d = spatial.nearest_boundary(t("fx_points"), t.edges(), 600.0).where(F.col("dist") < spatial.FAR)
    return d.agg(F.count("*").alias("n"), F.round(F.min("dist"), 3).alias("least"), F.round(F.max("dist"), 3).alias("most"))


@query("geo7_components", f"{REGIONS} select cast(n as int) as n, cells, count(*) as regions from reg group by 1, 2")
def geo7(t):
    """Regions of equal count: how many of each size."""
    return raster.patches(raster.sweep(t.runs())).groupBy("n", "cells").agg(F.count("*").alias("regions"))


@query("geo8_sieved")
def geo8(t):
    """Burn counts after specks of fewer than 16 cells took their largest neighbour's value, per row and count."""
    s = raster.sieve(raster.sweep(t.runs()), 16)
    return s.groupBy("row", "n").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"), F.min("c0").alias("c_min"), (F.max("c1") - 1).alias("c_max"))


def product_of(t, least: int):
    """The repeat-burn product as GeoJSON lines, read back: patches, closed outlines and acres of each count."""
    path = fresh_path(t.spark, "repeats")
    sinks.geojson_lines(product.repeat_patches(raster.sweep(t.runs()), least), path, ["count", "acres"])
    schema = "type string, properties struct<count:int, acres:long>, geometry struct<type:string, coordinates:array<array<array<array<double>>>>>"
    back = t.spark.read.schema(schema).json(path).where("type = 'Feature' and geometry.type = 'MultiPolygon'")
    ring = F.col("geometry.coordinates")[0][0]
    closed = (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    by = back.select("properties.*", closed.alias("closed")).groupBy("count")
    return by.agg(F.count("*").alias("patches"), F.count_if("closed").alias("outlines"), F.sum("acres").alias("acres"))


@query("snk1_repeats_product")
def snk1_repeats(t):
    """The repeat-burn download end to end: sieved counts to simplified outlines in degrees."""
    return product_of(t, product.SIEVE)


@query("snk1_repeats_unsieved", f"""{REGIONS} select cast(n as int) as count, count(*) as patches, count(*) as outlines, cast(sum(cast(round(cells*8100/4046.86e0) as bigint)) as bigint) as acres from reg where n >= 2 group by 1""")
def snk1_unsieved(t):
    """The same without the sieve, so that every patch of a count is one of the raster's."""
    return product_of(t, 1)


@query("geo9_patches", f"""{CORNERS} select cast(c.n as int) as n, c.cells, cast((count(*) filter (k = 1) - count(*) filter (k = 3) + 2 * count(*) filter (facing)) // 4 as bigint) as outlines_less_holes,
cast(count(*) filter (k in (1, 3)) + 2 * count(*) filter (facing) as bigint) as corners from k join (select n, count(*) as cells from counts group by n) c on c.n = k.n group by 1, 2""")
def geo9(t):
    """Reburned patches as rings: the rings' signed areas are the cells, and their turns those of the raster.

    Outlines count 1 and holes -1; each is in order, so its shoelace area and its corners are what the grid has.
    """
    lab = written(raster.label_components(raster.sweep(t.runs()).where("n >= 2")), "patch-labels")
    rows = rings.shapes(rings.rings(lab), raster.CELL).join(lab.select("comp", "n").distinct(), "comp")
    cells = F.round(F.sum("area") / (raster.CELL * raster.CELL)).cast("long")
    return rows.groupBy("n").agg(cells.alias("cells"), F.sum(F.signum("area")).cast("long").alias("outlines_less_holes"), F.sum(F.size("pts") - 1).cast("long").alias("corners"))


#: Draws of a check, as many as there are anywhere in the record to look at.
DRAWS = 800


def drawn(total: str, seed: int = 7) -> str:
    """SQL of spatial.draw() for a column d."""
    a = f"((d + {seed}) * 48271 % 2147483647)"
    return f"({a} * 2147483647 + ({a} * 69621 + 1) % 2147483647) % {total}"


@query("geo14_weighted_cells", f"""{COUNTS}, i as (select row, col, n, row_number() over (order by row, col) - 1 as i from counts where n >= 2), d as (select cast(unnest(range(1, {DRAWS} + 1)) as bigint) as d),
v as (select d, {drawn('(select count(*) from i)')} as v from d where (select count(*) from i) > 0) select d, row, col, cast(n as int) as n from v join i on i.i = v.v""")
def geo14(t):
    """Patches drawn by their acres, with replacement, and a cell inside each."""
    return spatial.weighted_cells(raster.sweep(t.runs()).where("n >= 2"), DRAWS)


@query("geo14_perimeter_cells", f"""{CELLS}, f as (select id, count(*) as cells, row_number() over (order by id) - 1 as i from cells group by id), c as (select id, row, col, row_number() over (partition by id order by row, col) - 1 as j from cells),
d as (select cast(unnest(range(1, {DRAWS} + 1)) as bigint) as d), v as (select d, {drawn('(select count(*) from f)')} as v from d where (select count(*) from f) > 0)
select v.d, f.id, c.row, c.col from v join f on f.i = v.v join c on c.id = f.id and c.j = {drawn('f.cells', 8)}""")
def geo14_fires(t):
    """Fires drawn alike, with replacement, and a cell inside each."""
    return spatial.perimeter_cells(t.runs(), DRAWS)


@query("geo1_albers_round_trip", f"{fx('fx_track_points')} select track, seg, pt, round(lon, 7) as lon, round(lat, 7) as lat from fx_track_points")
def geo1(t):
    """Degrees to projected metres and back: the same degrees."""
    x, y = geom.albers_forward(F.col("lon"), F.col("lat"))
    p = t("fx_track_points").withColumn("d", geom.albers_inverse(x, y))
    return p.select("track", "seg", "pt", F.round("d.lon", 7).alias("lon"), F.round("d.lat", 7).alias("lat"))


@query("jn15_largest_has_geometry", f"""{fx('fx_edges', 'fx_mosaic')}, {RECORD}, big as (select year, id from rec qualify row_number() over (partition by year order by coalesce(acres, 0e0) desc, id) = 1),
rec_edges as (select e.* from fx_edges e join big using (id)), {REC_CELLS}, isl as (select id, row, col, col - row_number() over (partition by id, row order by col) as g from cells),
run as (select id, row, min(col) as c0, count(*) as len from isl group by id, row, g), pt as (select id, row, c0 + len // 2 as col from run qualify row_number() over (partition by id order by len desc, row, c0) = 1)
select b.year, b.id, (select count(*) % 2 = 1 from rec_edges e where e.id = b.id and least(e.y0,e.y1) <= 45+90*pt.row and 45+90*pt.row < greatest(e.y0,e.y1) and e.x0 + (45e0+90*pt.row-e.y0)*(e.x1-e.x0)/(e.y1-e.y0) <= 45+90*pt.col) as has_perimeter,
exists(select 1 from fx_mosaic m where m.year = b.year and m.row = pt.row and m.c0 <= pt.col and pt.col < m.c1 and m.class between 1 and 5) as has_severity from big b left join pt on pt.id = b.id""")
def jn15(t):
    """At a point inside each year's largest fire: is that fire's own perimeter there, and severity of its year?"""
    big = written(fi.largest_of_each_year(t.record()).select("year", "id"), "largest")  # a row a year
    edges = written(t.edges().join(F.broadcast(big), "id", "left_semi"), "largest-edges")
    length = F.col("c1") - F.col("c0")
    longest = F.max(F.struct(length.alias("len"), (-F.col("row")).alias("r"), (-F.col("c0")).alias("c")))
    at = raster.rasterise(edges).groupBy("id").agg(longest.alias("m")).select("id", (-F.col("m.r")).alias("row"), (F.floor(F.col("m.len") / 2) - F.col("m.c")).alias("col"))
    return verify.present(big.join(at, "id"), big, edges, t("fx_mosaic").where("class between 1 and 5"), raster.CELL)


def _filled() -> None:
    from cinderframe.sources.record import DERIVED

    for name, sql in ORACLES.items():
        ORACLES[name] = sql.replace("{mosaic}", DERIVED["fx_mosaic"]).replace("{points}", DERIVED["fx_points"])


_filled()
