"""Queries over landed files: each writes what the record's tables give in a format, and reads that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.functions import scalar
from cinderframe.jobs import sinks
from cinderframe.jobs.common import RECORD, fx, register
from cinderframe.operators import fires as fi
from cinderframe.operators import geom
from cinderframe.sources import files, published
from cinderframe.sources.scratch import fresh_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

SHAPES = "n as (select id, count(*) as edges, count(distinct part) as parts, count(distinct part * 100 + ring) as rings from fx_edges group by id)"
#: Features of one document; a document is one task's work to read.
DOCUMENT = 1_000


def shape_sizes(shapes: DataFrame) -> DataFrame:
    rings = F.flatten("geom")
    return shapes.select("id", F.size("geom").alias("parts"), F.size(rings).alias("rings"), F.size(F.flatten(rings)).alias("points"))


@query("src2_gz_features", f"{fx('fx_edges')}, {RECORD}, {SHAPES} select id, cast(parts as int) as parts, cast(rings as int) as rings, cast(edges + rings as int) as points from rec join n using (id)")
def src2(t):
    """Gzipped FeatureCollections of at most DOCUMENT fires, read to geometry."""
    line = sinks.feature(F.struct("id"))
    shapes = geom.nest(t.edges()).join(t.record().select("id", F.floor(F.col("k") / DOCUMENT).alias("document")), "id")
    value = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(line), ","), F.lit("]}"))
    path = fresh_path(t.spark, "collections")
    shapes.groupBy("document").agg(value.alias("value")).write.partitionBy("document").text(path, compression="gzip")
    return shape_sizes(files.multipolygons(files.features(t.spark, path)).select(F.col("properties")["id"].alias("id"), "geom"))


@query("snk1_geojson_lines", f"{fx('fx_edges')}, {RECORD}, {SHAPES} select id, cast(parts as int) as parts, cast(rings as int) as rings, cast(edges + rings as int) as points from rec join n using (id)")
def snk1(t):
    """Fires as one GeoJSON feature a line, gzipped, read back: parts, rings and points all there."""
    path = fresh_path(t.spark, "lines")
    sinks.geojson_lines(geom.nest(t.edges()), path, ["id"])
    schema = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
    back = t.spark.read.schema(schema).json(path).where("type = 'Feature'")
    rows = back.select("properties", F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"))
    return shape_sizes(files.multipolygons(rows).select(F.col("properties")["id"].alias("id"), "geom"))


@query("snk8_clean_start", f"{fx('fx_edges')}, {RECORD} select count(*) as features from rec where id in (select id from fx_edges)")
def snk8(t):
    """Written twice to one path, features are there once."""
    path, shapes = fresh_path(t.spark, "twice"), geom.nest(t.edges())
    for _ in range(2):
        sinks.geojson_lines(shapes, path, ["id"])
    return t.spark.read.text(path).agg(F.count("*").alias("features"))


GPX = """w as (select section, way, pt, lat, lon, dense_rank() over (partition by section order by way) - 1 as seg, row_number() over (partition by section, way order by pt) - 1 as i from fx_way_points)
select s.name as track, cast(w.seg as int) as seg, cast(w.i as int) as pt, round(lat, 6) as lat, round(lon, 6) as lon from w join fx_sections s using (section)"""


@query("src5_gpx_points", f"{fx('fx_sections', 'fx_way_points')}, {GPX}")
def src5(t):
    """One GPX file per section, six decimals, names escaped; read back to points (SNK4, FN10)."""
    names = t("fx_sections").select("section", scalar.slug(F.col("name")).alias("slug"), "name")
    points = t("fx_way_points").join(names, "section").select("slug", "name", F.col("way").alias("seg"), "pt", "lat", "lon")
    path = fresh_path(t.spark, "gpx")
    sinks.gpx(points, path)
    return files.gpx_points(t.spark, f"{path}/*").select("track", "seg", "pt", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("src6_osm_members", f"""{fx('fx_way_points')}, m as (select s_nationkey as rel_id, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as pos, s_suppkey as way from supplier),
n as (select way, count(*) as n from fx_way_points group by way) select rel_id, cast(pos as int) as pos, way, cast(n as int) as n from m join n using (way)""")
def src6(t):
    """OSM JSON documents, one a section: relations with members in order, and ways with geometry."""
    ways = t("supplier").select(F.col("s_nationkey").alias("section"), F.col("s_suppkey").alias("way"))
    node = F.transform(F.sort_array(F.collect_list(F.struct("pt", F.struct("lat", "lon").alias("p")))), lambda s: s["p"])
    shapes = t("fx_way_points").groupBy("way").agg(node.alias("geometry"))
    kinds = "array<struct<type:string,ref:bigint>>"
    rows = ways.join(shapes, "way", "left")
    way = rows.select("section", F.struct(F.lit("way").alias("type"), F.col("way").alias("id"), F.lit(None).cast(kinds).alias("members"), "geometry").alias("e"))
    members = F.transform(F.sort_array(F.collect_list("way")), lambda w: F.struct(F.lit("way").alias("type"), w.alias("ref")))
    none = F.lit(None).cast("array<struct<lat:double,lon:double>>")
    relation = ways.groupBy("section").agg(members.alias("m")).select("section", F.struct(F.lit("relation").alias("type"), F.col("section").alias("id"), F.col("m").cast(kinds).alias("members"), none.alias("geometry")).alias("e"))
    docs = way.unionByName(relation).groupBy("section").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value"))
    path = fresh_path(t.spark, "osm")
    docs.write.partitionBy("section").text(path)
    members, shapes = files.osm_elements(t.spark, path)
    return members.join(shapes.select(F.col("id").alias("ref"), F.size("geometry").alias("n")), "ref").select("rel_id", "pos", F.col("ref").alias("way"), "n")


@query("src7_year_manifest", "select distinct cast(p_partkey % 41 + 1980 as int) as year, 'mosaic-' || cast(p_partkey % 41 + 1980 as varchar) || '.zip' as url from part")
def src7(t):
    """A JSON object of year -> address."""
    years = t("part").select((F.col("p_partkey") % 41 + 1980).cast("string").alias("y")).distinct()  # 41 at most
    entry = F.struct("y", F.concat(F.lit("mosaic-"), F.col("y"), F.lit(".zip")).alias("url"))
    path = fresh_path(t.spark, "manifest")
    years.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)
    return files.year_manifest(t.spark, path)


@query("src8_artefacts", "select p_brand, cast(length(string_agg(p_name, chr(10) order by p_partkey)) + 1 as bigint) as size, md5(string_agg(p_name, chr(10) order by p_partkey) || chr(10)) as md5 from part group by p_brand")
def src8(t):
    """Sizes and checksums of files, one a brand."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"])
    path = fresh_path(t.spark, "artefacts")
    t("part").groupBy("p_brand").agg(F.array_join(lines, "\n").alias("value")).write.partitionBy("p_brand").text(path)
    return files.artefacts(t.spark, path, "p_brand").select("p_brand", "size", "md5")


@query("snk2_class_stats", f"{fx('fx_stats')}, {RECORD} select r.year, s.id, s.class, s.px from fx_stats s join rec r using (id)")
def snk2(t):
    """Per-fire class counts as year partitions and as JSON maps; the maps read back are the rows."""
    stats = t("fx_stats").join(t.record().select("id", "year"), "id")
    path, maps = fresh_path(t.spark, "stats"), fresh_path(t.spark, "stat-maps")
    sinks.year_partitions(stats, path)
    sinks.class_maps(t.spark.read.parquet(path), maps)
    return files.severity_stats(t.spark, maps, "year").select(F.col("year").cast("int").alias("year"), "id", "class", "px")


@query("snk6_resumed_years", f"{fx('fx_fires', 'fx_stats')}, {RECORD} select r.year, count(distinct r.id) as fires, count(s.id) as stats from rec r left join fx_stats s on s.id = r.id and s.class between 1 and 5 group by 1")
def snk6(t):
    """Years built, one broken off between severity and perimeters, and resumed: each is whole, none twice."""
    rec, stats = t.record(), fi.drawable(t("fx_stats")).join(t.record().select("id", "year"), "id")
    severity, perimeters = fresh_path(t.spark, "years-severity"), fresh_path(t.spark, "years-perimeters")

    def build(year: int) -> tuple[DataFrame, DataFrame]:
        return stats.where(F.col("year") == year), rec.where(F.col("year") == year).select("id", "year")

    years = rec.select("year").distinct()
    sinks.rebuild_years(t.spark, years.where("year < 1998"), build, severity, perimeters)
    sinks.year_partitions(build(1999)[0], severity)  # a run that ended before its perimeters
    sinks.rebuild_years(t.spark, years, build, severity, perimeters)
    n = t.spark.read.parquet(severity).groupBy("year").agg(F.count("*").alias("stats"))
    p = t.spark.read.parquet(perimeters).groupBy("year").agg(F.countDistinct("id").alias("fires"))
    return p.join(n, "year", "left").select("year", "fires", F.coalesce("stats", F.lit(0)).alias("stats"))


@query("snk6_published_years", f"{fx('fx_fires')}, {RECORD} select year, count(*) as fires, sum(k) as keys, cast(case when year = 1997 then 3 when year < 1998 then 1 else 2 end as int) as version from rec group by year")
def snk6_published(t):
    """Years published in three commits with a writer that broke off between: readers see the last of each year, whole."""
    path, rec = fresh_path(t.spark, "published"), t.record().select("id", "k", "year")
    published.publish(rec.where("year < 1998"), path)
    published.publish(rec.where("year >= 1998"), path)
    published.staged(rec.where("year = 1996"), path)  # written aside, never named
    published.publish(rec.where("year = 1997"), path)
    version = [(y, v["version"]) for y, v in published.manifest(t.spark, path)[1].items()]  # a row a year
    by = published.read(t.spark, path).groupBy("year").agg(F.count("*").alias("fires"), F.sum("k").alias("keys"))
    return by.join(F.broadcast(t.spark.createDataFrame(version, "year int, version int")), "year")


@query("fn5_rounded_coordinates", f"""{fx('fx_edges')}, {RECORD}, m as (select e.id, part, ring, seq, x0 as a, y0 as b from fx_edges e join rec using (id)),
r as (select *, a // 10 + case when a % 10 > 5 then 1 when a % 10 = 5 then (a // 10) % 2 else 0 end as p, b // 10 + case when b % 10 > 5 then 1 when b % 10 = 5 then (b // 10) % 2 else 0 end as q from m)
select id, part, ring, seq, (p - 1200000) / 1e4 as x, (q + 400000) / 1e4 as y from r""")
def fn5(t):
    """Nested degrees rounded to four decimals, ties to even on the decimal text."""
    def degrees(c, base: int):
        return ((c.cast("decimal(20,0)") + F.lit(base * 100_000)) / F.lit(100_000)).cast("double")

    shift = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(degrees(q["x"], -120).alias("x"), degrees(q["y"], 40).alias("y")))))
    shapes = geom.nest(t.edges()).select("id", scalar.round_coordinates(shift, 4).alias("geom"))
    return geom.edges_of(shapes).select("id", "part", "ring", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))


@query("fn8_degrees_to_metres", f"{fx('fx_track_points')} select track, seg, pt, round(0.01e0 * 111320e0 * cos(radians(lat)), 6) as metres from fx_track_points")
def fn8(t):
    return t("fx_track_points").select("track", "seg", "pt", F.round(scalar.degrees_to_metres(F.lit(0.01), F.col("lat")), 6).alias("metres"))


@query("fn11_counts_or_zero", f"{fx('fx_stats')} select id, " + ", ".join(f"cast(sum(case when class = {c} then px else 0 end) as bigint) as c{c}" for c in range(1, 7)) + " from fx_stats group by id")
def fn11(t):
    """Counts of a map by class, zero where it has none."""
    maps = t("fx_stats").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("string"), "px"))).alias("m"))
    return maps.select("id", *[scalar.count_of(F.col("m"), c).cast("long").alias(f"c{c}") for c in range(1, 7)])
