"""Writers: GeoJSON lines, GPX, tile layers, and year partitions that can be rebuilt and resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def feature(properties: Column) -> Column:
    """A compact MultiPolygon feature as JSON text; the column geom is part -> ring -> point."""
    coords = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def class_maps(stats: DataFrame, path: str) -> None:
    """A JSON object a year (fire -> {class -> pixels}) as text, one entry a line of a fire."""
    entry = F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("string"), "px")))
    by = stats.groupBy("year", "id").agg(entry.alias("h"))
    by.select("year", F.to_json(F.create_map("id", "h")).alias("value")).write.mode("overwrite").partitionBy("year").text(path)


def geojson_lines(rows: DataFrame, path: str, properties: list[str]) -> None:
    """One feature a line, gzipped."""
    line = feature(F.struct(*properties))
    rows.select(line.alias("value")).write.mode("overwrite").text(path, compression="gzip")


def gpx(points: DataFrame, path: str) -> None:
    """One GPX folder per section (slug), six decimals; points: (slug, name, seg, pt, lat, lon)."""
    def six(c: Column) -> Column:
        return F.format_string("%.6f", c)

    pt = F.struct("pt", F.struct(six(F.col("lat")).alias("_lat"), six(F.col("lon")).alias("_lon")).alias("p"))
    segs = points.groupBy("slug", "name", "seg").agg(F.transform(F.sort_array(F.collect_list(pt)), lambda s: s["p"]).alias("trkpt"))
    seg = F.struct("seg", F.struct("trkpt").alias("s"))
    tracks = segs.groupBy("slug", "name").agg(F.transform(F.sort_array(F.collect_list(seg)), lambda s: s["s"]).alias("trkseg"))
    tracks.write.mode("overwrite").partitionBy("slug").format("xml").option("rowTag", "trk").option("rootTag", "gpx").save(path)


def year_partitions(df: DataFrame, path: str) -> None:
    """Replace exactly the years that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def tile_layer(tiles: DataFrame, path: str) -> None:
    tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "year", "z").parquet(path)


def stored_years(spark: SparkSession, path: str) -> DataFrame:
    """Years that have a partition; none if nothing was written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "year int")
    return spark.read.parquet(path).select(F.col("year").cast("int").alias("year")).distinct()


def rebuild_years(spark: SparkSession, years: DataFrame, build, severity_path: str, perimeter_path: str) -> list[int]:
    """Build the years that aren't finished; returns them.

    A year is finished once its perimeters are there: severity is written first and perimeters last,
    so a broken run is repeated whole. An overwrite clears no partition that gets no rows, so a year
    whose severity is now empty has its old one deleted. ``build(year)`` gives (severity, perimeters).
    """
    todo = [r["year"] for r in years.select("year").distinct().join(stored_years(spark, perimeter_path), "year", "left_anti").orderBy("year").collect()]
    for y in todo:
        severity, perimeters = build(y)
        if severity.limit(1).count():
            year_partitions(severity, severity_path)
        else:
            _delete(spark, f"{severity_path}/year={y}")
        year_partitions(perimeters, perimeter_path)
    return todo


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows and new ones; a key that the new have is theirs alone."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
