"""Readers of the formats the record arrives in; Parquet is what jobs read again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, kind, coordinates) of a GeoJSON FeatureCollection, gzipped or not.

    Coordinates stay JSON text until the kind says how deep they nest. One document is one task:
    convert it to Parquet once.
    """
    schema = "features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def multipolygons(rows: DataFrame) -> DataFrame:
    """features() rows with ``geom``: polygons promoted to one-part multipolygons."""
    deep = F.from_json("coordinates", "array<array<array<array<double>>>>")
    flat = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("kind") == "MultiPolygon", deep).otherwise(flat)
    geom = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
    return rows.where(F.col("kind").isin("Polygon", "MultiPolygon")).withColumn("geom", geom).drop("coordinates", "kind")


def severity_stats(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """(id, class, px) of JSON objects fire -> {class -> pixels}, a line each, and the folder's columns ``keep``."""
    maps = spark.read.text(path).select(*keep, F.from_json("value", "map<string,map<string,bigint>>").alias("m"))
    per = maps.select(*keep, F.explode("m").alias("id", "h")).select(*keep, "id", F.explode("h").alias("class", "px"))
    return per.select(*keep, "id", F.col("class").cast("int").alias("class"), "px")


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, track, seg, pt, lat, lon) of GPX tracks and routes; several of a file stay apart by name.

    A route is a track of one segment.
    """
    points = "array<struct<_lat:double,_lon:double>>"
    rows = spark.read.format("xml").option("rowTag", "trk").schema(f"name string, trkseg array<struct<trkpt:{points}>>").load(path).select("name", "trkseg", "_metadata")
    routes = spark.read.format("xml").option("rowTag", "rte").schema(f"name string, rtept {points}").load(path)
    rows = rows.unionByName(routes.select("name", F.array(F.struct(F.col("rtept").alias("trkpt"))).alias("trkseg"), "_metadata"))
    segs = rows.select(F.col("_metadata.file_name").alias("file"), F.col("name").alias("track"), F.posexplode("trkseg").alias("seg", "s"))
    return segs.select("file", "track", "seg", F.posexplode("s.trkpt").alias("pt", "p")).select("file", "track", "seg", "pt", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"))


def osm_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, ways): relation members in order (rel_id, pos, type, ref), and ways with geometry."""
    schema = "elements array<struct<type:string, id:bigint, members:array<struct<type:string, ref:bigint>>, geometry:array<struct<lat:double, lon:double>>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    members = e.where("e.type = 'relation'").select(F.col("e.id").alias("rel_id"), F.posexplode("e.members").alias("pos", "m"))
    ways = e.where("e.type = 'way' and size(e.geometry) > 0").select("e.id", "e.geometry")
    return members.select("rel_id", "pos", "m.type", "m.ref"), ways


def year_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(year, url) of a JSON object: year -> address."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return maps.select(F.explode("m").alias("y", "url")).select(F.col("y").cast("int").alias("year"), "url")


def artefacts(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """(key, size, md5) of the files of a folder, and the folder's columns ``keep``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(*keep, F.element_at(F.split("path", "/"), -1).alias("key"), F.col("length").alias("size"), F.md5("content").alias("md5"))
