"""Queries over trails, tracks and tile layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions import scalar
from cinderframe.jobs import sinks
from cinderframe.jobs.common import REC_CELLS, REC_EDGES, RECORD, TAGGED, fx, register
from cinderframe.operators import fires, geom, quadtree, raster, spatial, tiles, trail
from cinderframe.sources.scratch import fresh_path, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

MILES = """case when lon1 is not null then 2 * 3958.7613e0 * asin(least(1e0, sqrt(power(sin(radians(lat1-lat)/2), 2) + cos(radians(lat))*cos(radians(lat1))*power(sin(radians(lon1-lon)/2), 2)))) end"""
WAYS = "s as (select *, lead(lon) over w as lon1, lead(lat) over w as lat1 from fx_way_points window w as (partition by section, way order by pt))"
BOXES = """b as (select id, -120e0 + min(least(x0,x1))*0.00001e0 as lon0, 40e0 + min(least(y0,y1))*0.00001e0 as lat0, -120e0 + max(greatest(x0,x1))*0.00001e0 as lon1, 40e0 + max(greatest(y0,y1))*0.00001e0 as lat1, count(*) as nv from rec_edges group by id)"""
TILED = f"""{fx('fx_edges')}, {RECORD}, {REC_EDGES}, {BOXES}, z as (select b.*, unnest(range(2, 14)) as z from b),
zx as (select *, unnest(range(cast(floor((lon0+180)/360*power(2, z)) as bigint), cast(floor((lon1+180)/360*power(2, z)) as bigint)+1)) as x from z),
t as (select *, unnest(range(cast(floor((1-ln(tan(radians(lat1))+1/cos(radians(lat1)))/pi())/2*power(2, z)) as bigint), cast(floor((1-ln(tan(radians(lat0))+1/cos(radians(lat0)))/pi())/2*power(2, z)) as bigint)+1)) as y from zx)"""
STEPS = """seg as (select track, seg, pt, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from fx_track_points window w as (partition by track, seg order by pt)),
sl as (select *, sqrt(cast((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) as double)) as len from seg where x1 is not null),
st as (select *, cast(greatest(1, ceil(len/40)) as int) as n from sl), sp as (select *, unnest(range(0, n)) as i from st),
steps as (select track, track*100000000 + seg*1000000 + pt*10000 + i as pt, x0 + (i*1e0/n)*(x1-x0) as x, y0 + (i*1e0/n)*(y1-y0) as y from sp)"""


@query("jn11_ordered_ways", f"""{fx('fx_sections', 'fx_way_points')}, w as (select section, way, cast(count(*) as int) as n from fx_way_points group by 1, 2)
select s.pos as sec_pos, s.section, cast(m.s_suppkey as int) as way_pos, m.s_suppkey as way, w.n from fx_sections s join supplier m on m.s_nationkey = s.section join w on w.way = m.s_suppkey and w.section = s.section""")
def jn11(t):
    """Relation to sections to ways, in order; ways without geometry drop out."""
    relation = t("fx_sections").select("pos", F.col("section").alias("ref"))
    members = t("supplier").select(F.col("s_nationkey").alias("section"), F.col("s_suppkey").cast("int").alias("pos"), F.col("s_suppkey").alias("ref"))
    ways = t("fx_way_points").groupBy("way").agg(F.collect_list("pt").alias("pts"))
    return trail.ordered_ways(relation, members, ways)


@query("win5_segment_miles", f"{fx('fx_way_points')}, {WAYS} select section, way, pt, round({MILES}, 6) as miles from s")
def win5(t):
    return trail.segment_miles(t("fx_way_points"), ["section", "way"]).select("section", "way", "pt", F.round("miles", 6).alias("miles"))


@query("win6_distance_along", f"{fx('fx_way_points')}, {WAYS}, m as (select *, {MILES} as miles from s) select section, way, pt, round(coalesce(sum(miles) over (partition by section, way order by pt rows between unbounded preceding and 1 preceding), 0), 6) as along from m")
def win6(t):
    return trail.distance_along(t("fx_way_points"), ["section", "way"]).select("section", "way", "pt", F.round("along", 6).alias("along"))


def thinning(pts: str, keys: str, eps: str) -> str:
    """SQL of geom.thin() over a table pts (keys, k, x, y): CTEs seg and kept (keys, k).

    Each step finds a stretch's farthest point, the first of equals, and cuts there if it is beyond eps.
    """
    own, on = ", ".join(f"s.{c}" for c in keys.split(", ")), lambda t: " and ".join(f"{t}.{c} = s.{c}" for c in keys.split(", "))
    tt = "case when l = 0 then 0e0 else least(1e0, greatest(0e0, ((px-ax)*dx + (py-ay)*dy) / l)) end"
    return f"""seg as (select {keys}, min(k) as a, max(k) as b from {pts} group by {keys} union all
select {keys}, case when h = 0 then a else i end as a, case when h = 0 then i else b end as b from (
  select {keys}, a, b, (array_agg(k order by d desc, k))[1] as i, max(d) as d from (
    select *, sqrt(power(px - (ax + tt*dx), 2) + power(py - (ay + tt*dy), 2)) as d from (select *, {tt} as tt from (
      select {own}, s.a, s.b, p.k, p.x as px, p.y as py, pa.x as ax, pa.y as ay, pb.x-pa.x as dx, pb.y-pa.y as dy, (pb.x-pa.x)*(pb.x-pa.x)+(pb.y-pa.y)*(pb.y-pa.y) as l
      from seg s join {pts} p on {on('p')} and p.k > s.a and p.k < s.b join {pts} pa on {on('pa')} and pa.k = s.a join {pts} pb on {on('pb')} and pb.k = s.b))) q group by {keys}, a, b) c, (values (0), (1)) h(h) where d > {eps}),
kept as (select {keys}, a as k from seg union select {keys}, b from seg)"""


THIN_WAYS = f"{fx('fx_way_points').replace('with ', 'with recursive ', 1)}, pts as (select section, way, pt as k, lon as x, lat as y from fx_way_points), {thinning('pts', 'section, way', '0.00009e0')}"
THIN_MILES = f"""k as (select p.section, p.way, p.pt, p.lon, p.lat from fx_way_points p join kept q on q.section = p.section and q.way = p.way and q.k = p.pt),
ks as (select *, lead(lon) over w as lon1, lead(lat) over w as lat1 from k window w as (partition by section, way order by pt)), km as (select *, {MILES} as miles from ks)"""


@query("agg15_section_totals", f"""{THIN_WAYS}, {WAYS}, m as (select *, {MILES} as miles from s), {THIN_MILES},
a as (select section, grouping(section) as g, count(*) as points, round(coalesce(sum(miles), 0e0), 3) as miles from m group by rollup(section)), b as (select section, grouping(section) as g, count(*) as thin_points, round(coalesce(sum(miles), 0e0), 3) as thin_miles from km group by rollup(section))
select case when a.g = 1 then 'TOTAL' else cast(a.section as varchar) end as section, points, miles, thin_points, thin_miles from a join b on a.section is not distinct from b.section""")
def agg15(t):
    """Points and miles of each section and of all, as drawn and thinned by 0.00009 degrees."""
    rows = trail.section_report(t("fx_way_points"), ["section", "way"], 0.00009)
    return rows.withColumn("section", F.coalesce(F.col("section").cast("string"), F.lit("TOTAL")))


@query("fn3_section_names", f"{fx('fx_sections')} select section, replace(replace(replace(lower(name), 'pct - ', ''), ' section ', '-'), ' ', '-') as slug, replace(replace(name, 'PCT - ', 'PCT — '), ' Section ', ' ') as short from fx_sections")
def fn3(t):
    return t("fx_sections").select("section", scalar.slug(F.col("name")).alias("slug"), scalar.short_name(F.col("name")).alias("short"))


@query("geo10_simplified_ways", f"{THIN_WAYS} select p.section, p.way, cast(count(*) as int) as before, cast(count(q.k) as int) as after from pts p left join kept q on q.section = p.section and q.way = p.way and q.k = p.k group by 1, 2")
def geo10(t):
    """Ways thinned by 0.00009 degrees, with the points before and after."""
    lines = t("fx_way_points").groupBy("section", "way").agg(F.transform(F.sort_array(F.collect_list(F.struct("pt", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")))), lambda s: s["p"]).alias("pts"))
    thin = geom.simplified(lines.withColumn("before", F.size("pts")), 0.00009)
    return thin.select("section", "way", "before", F.size("pts").alias("after"))


RINGS = "pts as (select id, part, ring, seq as k, x0*1e0 as x, y0*1e0 as y from rec_edges union all select id, part, ring, n, x0, y0 from (select *, count(*) over (partition by id, part, ring) as n from rec_edges) where seq = 0)"
RING_SUMS = "select count(distinct id) as fires{s}, count(*) as rings{s}, cast(sum(n - 1) as bigint) as vertices{s}, sum(case when ring = 0 then a else -a end) as area{s} from (select id, part, ring, count(*) as n, abs(sum(x*y1 - x1*y))/2 as a from {t} group by 1, 2, 3) where n >= 4"
NEXT = "(select *, lead(x, 1, x) over w as x1, lead(y, 1, y) over w as y1 from {t} window w as (partition by id, part, ring order by k))"


@query("agg16_thinned_perimeters", f"""{fx('fx_edges').replace('with ', 'with recursive ', 1)}, {RECORD}, {REC_EDGES}, {RINGS}, {thinning('pts', 'id, part, ring', '500e0')}, thin as (select p.* from pts p join kept q on q.id = p.id and q.part = p.part and q.ring = p.ring and q.k = p.k)
select * from ({RING_SUMS.format(s='', t=NEXT.format(t='pts'))}), ({RING_SUMS.format(s='_thin', t=NEXT.format(t='thin'))})""")
def agg16(t):
    """Features, rings, vertices and area of perimeters before and after thinning by 500 m."""
    return geom.fidelity(t.edges(), 500.0)


def steps(t):
    """Track points at most 40 m apart, keyed by track, segment, point and step."""
    s = geom.densified(trail.track_segments(t("fx_track_points")), 40.0)
    return s.select("track", F.struct("track", "seg", "pt", "i").alias("pt"), "x", "y")


@query("geo13_track_steps", f"{fx('fx_track_points')}, {STEPS} select track, count(*) as steps, round(sum(x), 1) as sx, round(sum(y), 1) as sy from steps group by track")
def geo13(t):
    return steps(t).groupBy("track").agg(F.count("*").alias("steps"), F.round(F.sum("x"), 1).alias("sx"), F.round(F.sum("y"), 1).alias("sy"))


@query("srt2_track_report", f"""{fx('fx_track_points', 'fx_edges')}, {RECORD}, {REC_EDGES}, {STEPS}, box as (select id, min(least(x0,x1)) as xmin, max(greatest(x0,x1)) as xmax from rec_edges group by id),
hits as (select s.pt, s.track, e.id from steps s join rec_edges e on least(e.y0,e.y1) <= s.y and s.y < greatest(e.y0,e.y1) join box b on b.id = e.id and s.x between b.xmin and b.xmax
  where e.x0 + (s.y-e.y0)*(e.x1-e.x0)/(e.y1-e.y0) <= s.x group by 1, 2, 3 having count(*) % 2 = 1),
a as (select s.track, count(*) as steps, count(h.pt) as burned from steps s left join (select distinct pt from hits) h using (pt) group by 1),
f as (select track, string_agg(id, ',' order by ig_date desc, id desc) as fires from (select distinct h.track, h.id, r.ig_date from hits h join rec r using (id)) group by track)
select a.track, a.steps, a.burned, coalesce(f.fires, '') as fires from a left join f using (track)""")
def srt2(t):
    """Each track's steps, its burned steps, and the fires it crosses, most recent first."""
    s, edges = written(steps(t), "steps"), written(t.edges(), "edges")
    burned = spatial.perimeter_counts(s, edges).select(F.col("pt.track").alias("track"), "pt")
    crossed = spatial.inside_lists(s.select(F.col("track").alias("pt"), "x", "y"), edges, once=True).select(F.explode("pts").alias("track"), "id")
    return trail.report(s.select("track", "pt"), burned, crossed, t.record())


@query("til1_tiles_of_fires", f"{TILED} select cast(z as int) as z, x, y, count(*) as features from t group by 1, 2, 3")
def til1(t):
    return tiles.tiles_of(t.lonlat_boxes(), (2, 13)).groupBy("z", "x", "y").agg(F.count("*").alias("features"))


def features(t):
    """(layer, year, z, x, y, id, fire_year, nv, class, area, bytes) of fires on their tiles: perimeters merged over the years, severity by year."""
    boxes = tiles.tiles_of(t.lonlat_boxes(), ZOOMS).select("id", "z", "x", "y")
    nv = t.edges().groupBy("id").agg(F.count("*").alias("nv"))
    kind = t.record().select("id", F.col("year").alias("fire_year"), (F.col("k") % 5 + 1).cast("int").alias("class"))
    layer = F.explode(F.array(F.struct(F.lit("perimeters").alias("layer"), F.lit(0).alias("year")), F.struct(F.lit("severity").alias("layer"), F.col("fire_year").alias("year")))).alias("l")
    rows = boxes.join(nv, "id").join(geom.areas(t.edges()), "id").join(kind, "id").select("*", layer)
    return rows.select("l.*", "z", "x", "y", "id", "fire_year", "nv", "class", "area", (F.col("nv") * 8 + 40).alias("bytes"))


ZOOMS = (2, 13)
#: A degree of the derived tracks in metres.
DEGREE = 100_000.0
AREAS = "ar as (select id, part, ring, abs(sum(x0*y1-x1*y0))/2e0 as a from rec_edges group by 1, 2, 3), aa as (select id, sum(case when ring = 0 then a else -a end) as area from ar group by id)"
LAYERS = f"""{TILED}, {AREAS}, fl as (select l.layer, case when l.layer = 'severity' then r.year else 0 end as year, cast(t.z as int) as z, t.x, t.y, t.id, r.year as fire_year, t.nv, cast(r.k % 5 + 1 as int) as class, aa.area
from t join rec r using (id) join aa using (id), (values ('perimeters'), ('severity')) l(layer))"""
VISIBLE = f"{LAYERS}, fv as (select * from fl where z = 13 or area >= power(360e0 / power(2, z) / 4096 * 100000e0, 2))"


@query("til4_size_policy", f"""{LAYERS}, f as (select *, sum(nv*8+40) over (partition by year, z, x, y order by area desc, id rows unbounded preceding) <= 20000 as own from fl where layer = 'severity')
select year, z, x, y, count(*) filter (own) as kept, count(distinct class) filter (not own) as merged, sum(area) as area from f group by 1, 2, 3, 4""")
def til4(t):
    """Severity tiles over their byte budget keep the largest fires and merge the rest by class; no area is lost."""
    m = tiles.merged_tail(features(t).where("layer = 'severity'"), 20_000)
    return m.groupBy("year", "z", "x", "y").agg(F.count("id").alias("kept"), F.count_if(F.col("id").isNull()).alias("merged"), F.sum("area").alias("area"))


def layers(t):
    """Tile rows of both layers, without what is smaller than a pixel above the deepest zoom; of about 4 MB each."""
    f = tiles.visible(features(t), ZOOMS[1], DEGREE)
    return quadtree.tile_rows(f.select(*tiles.TILE, "id", "fire_year", "nv", "bytes"))


@query("til5_assembled_tiles", f"{VISIBLE} select layer, year, z, x, y, string_agg(cast(fire_year as varchar) || ':' || id || ':' || cast(nv as varchar), ',' order by fire_year, id) as features from fv group by 1, 2, 3, 4, 5")
def til5(t):
    """Tiles with their fires, oldest first; a tile of over 4 MB has several rows."""
    text = F.array_join(F.transform("features", lambda f: F.concat_ws(":", f["fire_year"].cast("string"), f["id"], f["nv"].cast("string"))), ",")
    return layers(t).select("layer", "year", "z", "x", "y", text.alias("features"))


@query("snk5_tile_layers", f"{VISIBLE} select layer, year, z, count(distinct (x, y)) as tiles, count(*) as features, cast(sum(nv) as bigint) as vertices from fv group by 1, 2, 3")
def snk5(t):
    """Tile layers written by layer, year and zoom, and read back."""
    path = fresh_path(t.spark, "tiles")
    sinks.tile_layer(layers(t), path)
    rows = t.spark.read.parquet(path).select("layer", "year", "z", "row", F.size("features").alias("n"), F.aggregate("features", F.lit(0).cast("long"), lambda s, f: s + f["nv"]).alias("nv"))
    # a tile has one row numbered 0
    return rows.groupBy("layer", "year", "z").agg(F.count_if(F.col("row") == 0).alias("tiles"), F.sum("n").alias("features"), F.sum("nv").alias("vertices"))


@query("agg10_tile_inventory", f"{VISIBLE}, d as (select fire_year, id, sum(nv) as nv from fv where z = 13 and layer = 'perimeters' group by 1, 2) select fire_year as year, count(*) as ids, cast(sum(nv) as bigint) as vertices from d group by 1")
def agg10(t):
    return tiles.inventory(layers(t).where("layer = 'perimeters'"))


@query("agg11_layer_years", f"{VISIBLE} select distinct layer, fire_year as year from fv")
def agg11(t):
    return layers(t).select("layer", F.explode("features.fire_year").alias("year")).distinct()


@query("til2_clipped_area", f"{fx('fx_edges')}, {RECORD}, {REC_EDGES}, {AREAS} select id, round(area, 2) as area from aa")
def til2(t):
    """Perimeters cut at the borders of 5 km blocks, every ring of every part: the pieces' areas add up again."""
    whole = tiles.cut_areas(geom.open_rings(t.edges()), 5000.0)
    return whole.groupBy("id").agg(F.round(F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))), 2).alias("area"))


#: The signed area of each ring inside each tile of its box, by integrating over edges: no clipping.
INSIDE_TILE = f"""{TILED}, de as (select id, part, ring, -120e0 + x0*0.00001e0 as p0, 40e0 + y0*0.00001e0 as q0, -120e0 + x1*0.00001e0 as p1, 40e0 + y1*0.00001e0 as q1 from rec_edges),
tb as (select id, z, x, y, x/power(2, z)*360-180 as w, (x+1)/power(2, z)*360-180 as e, degrees(atan((exp(pi()*(1-2*y/power(2, z)))-exp(-pi()*(1-2*y/power(2, z))))/2)) as n, degrees(atan((exp(pi()*(1-2*(y+1)/power(2, z)))-exp(-pi()*(1-2*(y+1)/power(2, z))))/2)) as s from t),
ce as (select z, x, y, w, e, id, part, ring, sign(q1-q0) as d, (p1-p0)/(q1-q0) as k, greatest(s, least(q0, q1)) as lo, least(n, greatest(q0, q1)) as hi, p0, q0 from de join tb using (id) where q0 <> q1),
xe as (select *, p0 + (lo-q0)*k as xa, p0 + (hi-q0)*k as xb from ce where lo < hi),
ra as (select id, z, x, y, part, ring, abs(sum(d * case when abs(xb-xa) < 1e-15 then (hi-lo) * (least(e, greatest(w, xa)) - w)
  else (hi-lo)/(xb-xa) * ((case when xb < w then 0 when xb < e then (xb-w)*(xb-w)/2 else (e-w)*(xb-w) - (e-w)*(e-w)/2 end) - (case when xa < w then 0 when xa < e then (xa-w)*(xa-w)/2 else (e-w)*(xa-w) - (e-w)*(e-w)/2 end)) end)) * 1e10 as a
  from xe group by all),
fa as (select id, z, x, y, sum(case when ring = 0 then a else -a end) as area from ra group by all)"""


def pieces(t):
    """The record's rings on all tiles of all zooms, in degrees."""
    return quadtree.quadtree(degrees(t.edges()), ZOOMS)


def degrees(edges):
    """Open rings (id, part, ring, xs, ys) of edges in degrees, by the scale of the derived tracks."""
    lon = F.transform("pts", lambda p: F.lit(-120.0) + p["x"] * 0.00001)
    lat = F.transform("pts", lambda p: F.lit(40.0) + p["y"] * 0.00001)
    rings = geom.closed_rings(edges).withColumn("pts", F.slice("pts", 1, F.size("pts") - 1))
    return rings.select("id", "part", "ring", lon.alias("xs"), lat.alias("ys"))


@query("til2_quadtree", f"{INSIDE_TILE} select cast(z as int) as z, x, y, count(*) filter (area >= 1) as fires, round(sum(area)/10000, 1) as ha from fa group by 1, 2, 3 having count(*) filter (area >= 1) > 0")
def til2_quadtree(t):
    """Perimeters cut down the tiles of every zoom, each piece from the one above: fires and ground on each tile."""
    f = quadtree.tile_features(pieces(t)).withColumn("area", F.col("area") * DEGREE * DEGREE)
    by = f.groupBy("z", "x", "y").agg(F.count_if(F.col("area") >= 1).alias("fires"), F.round(F.sum("area") / 10_000, 1).alias("ha"))
    return by.where("fires > 0")


def layer_rows(t, budget: int = 20_000):
    """Rows of both layers with their geometry: cut, thinned, without what is below a pixel, severity within its budget."""
    kind = t.record().select("id", F.col("year").alias("fire_year"), (F.col("k") % 5 + 1).cast("int").alias("class"))
    rings = geom.open_rings(t("fx_edges").join(kind, "id"), "fire_year", "class")
    points = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    rings = rings.select("id", "part", "ring", "fire_year", "class", F.transform("xs", lambda x: F.lit(-120.0) + x * 0.00001).alias("xs"), F.transform("ys", lambda y: F.lit(40.0) + y * 0.00001).alias("ys"), F.abs(geom.ring_area(points)).alias("m2"))
    f = quadtree.features(rings, ZOOMS, DEGREE, ("fire_year", "class"))
    f = written(f.withColumn("area", F.col("area") * DEGREE * DEGREE), "layer-features")
    one = F.lit(1).cast("long").alias("fires")
    merged = f.select(F.lit("perimeters").alias("layer"), F.lit(0).alias("year"), "z", "x", "y", "id", "fire_year", "class", "area", one, "geom", "bytes")
    severity = f.select(F.lit("severity").alias("layer"), F.col("fire_year").alias("year"), "z", "x", "y", "id", "fire_year", "class", "area", "bytes")
    own = written(tiles.within_budget(severity, budget), "tile-budget")  # without outlines, which only what fits is given again
    fits = own.where("own").select("id", "z", "x", "y").join(f, ["id", "z", "x", "y"])
    fits = fits.select(F.lit("severity").alias("layer"), F.col("fire_year").alias("year"), "z", "x", "y", "id", "fire_year", "class", "area", one, "geom", "bytes")
    tail = own.where("not own").groupBy(*tiles.TILE, "class").agg(F.max("fire_year").alias("fire_year"), F.sum("area").alias("area"), F.count("*").alias("fires"))
    # what doesn't fit keeps its ground and number by class, without an outline
    tail = tail.select(*tiles.TILE, F.lit(None).cast("string").alias("id"), "fire_year", "class", "area", "fires", F.lit(None).cast(f.schema["geom"].dataType).alias("geom"), F.lit(40).cast("long").alias("bytes"))
    return quadtree.tile_rows(merged.unionByName(written(fits.unionByName(tail), "severity-features")))


@query("til5_tile_geometry", f"""{INSIDE_TILE}, {AREAS}, fg as (select f.*, r.year as fire_year, r.k % 5 + 1 as class from fa f join rec r using (id) join aa using (id) where z = 13 or aa.area >= power(360e0 / power(2, z) / 4096 * 100000e0, 2)),
fl as (select l.layer, case when l.layer = 'severity' then fire_year else 0 end as year, cast(z as int) as z, x, y, area from fg, (values ('perimeters'), ('severity')) l(layer) where area >= 1)
select layer, year, z, x, y, round(sum(area)/10000, 1) as ha from fl group by 1, 2, 3, 4, 5""")
def til5_geometry(t):
    """Tile layers with their clipped, thinned outlines: the ground on each tile, whatever was merged or split over rows."""
    rows = layer_rows(t).select("layer", "year", "z", "x", "y", F.explode("features").alias("f"))
    by = rows.groupBy("layer", "year", "z", "x", "y").agg(F.round(F.sum("f.area") / 10_000, 1).alias("ha"), F.max("f.area").alias("most"))
    return by.where("most >= 1").drop("most")


@query("jn15_stored_geometry", f"""{fx('fx_edges', 'fx_stats')}, {RECORD}, {TAGGED}, big as (select year, id, sev_ok from tagged qualify row_number() over (partition by year order by coalesce(acres, 0e0) desc, id) = 1),
rec_edges as (select e.* from fx_edges e join big using (id)), {REC_CELLS}, inner_ as (select id, count(*) as cells from cells group by id)
select b.year, b.id, coalesce(cells, 0) > 0 as has_perimeter, coalesce(cells, 0) > 0 and sev_ok as has_severity from big b left join inner_ using (id)""")
def jn15_stored(t):
    """Each year's largest fire looked for in the written tile layers, by a point inside its source outline.

    The severity layer holds fires with mapped severity alone, so a year whose largest has none fails there.
    """
    tagged = written(t.tagged().select("id", "year", "acres", "sev_ok"), "tagged")
    big = written(fires.largest_of_each_year(tagged).select("year", "id"), "largest")  # a row a year
    edges = written(t.edges().join(F.broadcast(big), "id", "left_semi"), "largest-edges")
    length = F.col("c1") - F.col("c0")
    longest = F.max(F.struct(length.alias("len"), (-F.col("row")).alias("r"), (-F.col("c0")).alias("c"))).alias("m")
    at = raster.rasterise(edges).groupBy("id").agg(longest)
    middle = raster.CELL / 2
    x = (F.floor(F.col("m.len") / 2) - F.col("m.c")) * raster.CELL + middle
    y = -F.col("m.r") * raster.CELL + middle
    points = written(at.select("id", (F.lit(-120.0) + x * 0.00001).alias("lon"), (F.lit(40.0) + y * 0.00001).alias("lat")), "inner-points")
    deepest = ZOOMS[1]
    f = quadtree.tile_features(quadtree.on_tiles(degrees(t.edges()), deepest)).join(tagged.select("id", F.col("year").alias("fire_year"), "sev_ok"), "id")
    layer = F.explode(F.when(F.col("sev_ok"), F.array(F.lit("perimeters"), F.lit("severity"))).otherwise(F.array(F.lit("perimeters")))).alias("layer")
    f = f.select(layer, "z", "x", "y", "id", "fire_year", "geom", "bytes").withColumn("year", F.when(F.col("layer") == "severity", F.col("fire_year")).otherwise(0))
    path = fresh_path(t.spark, "stored-layers")
    sinks.tile_layer(quadtree.tile_rows(f), path)
    stored = t.spark.read.parquet(path)
    out = big
    for name, column in (("perimeters", "has_perimeter"), ("severity", "has_severity")):
        found = quadtree.has_geometry(stored.where(F.col("layer") == name), points, deepest).select("id", F.col("found").alias(column))
        out = out.join(found, "id", "left").withColumn(column, F.coalesce(column, F.lit(False)))
    return out.select("year", "id", "has_perimeter", "has_severity")


ZOOM_RINGS = f"{RINGS.replace('pts as', 'flat as')}, zs as (select cast(unnest(range(2, 14)) as int) as z), {AREAS}, keep as (select id, z from aa, zs where z = 13 or area >= power(360e0 / power(2, z) / 4096 * 100000e0, 2)), pts as (select f.*, z from flat f join keep using (id))"


@query("til3_thinned_by_zoom", f"""{fx('fx_edges').replace('with ', 'with recursive ', 1)}, {RECORD}, {REC_EDGES}, {ZOOM_RINGS}, {thinning('pts', 'id, part, ring, z', '360e0 / power(2, z) / 4096 * 100000e0')}
select z, count(distinct id) as fires, cast(sum(n) as bigint) as before, cast(sum(m) as bigint) as after from (select p.z, p.id, count(*) as n, count(q.k) as m from pts p left join kept q on q.id = p.id and q.part = p.part and q.ring = p.ring and q.z = p.z and q.k = p.k group by 1, 2) group by z""")
def til3(t):
    """All rings of the fires of each zoom thinned by a pixel's size; fires below a pixel drop out above the deepest zoom."""
    zooms = geom.areas(t.edges()).select("id", tiles.visible_zooms(F.col("area"), ZOOMS, DEGREE).alias("zs"))
    zooms = zooms.withColumn("eps", F.transform("zs", lambda z: tiles.pixel(z) * DEGREE))
    fires_ = zooms.select(F.explode("zs").alias("z")).groupBy("z").agg(F.count("*").alias("fires"))
    per = tiles.thinned_sums(geom.open_rings(t.edges()).join(zooms, "id"))
    return per.join(fires_, "z").select("z", "fires", F.col("n").alias("before"), F.col("m").alias("after"))
