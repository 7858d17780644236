"""Reconciliation of what was built with its source, by independent methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.operators.spatial import in_perimeters

BANDS = (130, 500)


def reconciled(source: DataFrame, built: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: state is ``missing`` (source only) or ``extra`` (built only)."""
    s = source.select(*keys).distinct().withColumn("in_source", F.lit(True))
    b = built.select(*keys).distinct().withColumn("in_built", F.lit(True))
    both = s.join(b, keys, "full_outer").where("in_source is null or in_built is null")
    return both.select(*keys, F.when(F.col("in_built").isNull(), "missing").otherwise("extra").alias("state"))


def object_state(size: Column, etag: Column, remote_size: Column, remote_etag: Column) -> Column:
    """A local object against its remote copy: size, then checksum unless it was sent in parts."""
    return (
        F.when(remote_size.isNull(), "missing").when(size.isNull(), "extra").when(size != remote_size, "size differs")
        .when(remote_etag.contains("-"), "size only").when(etag != remote_etag, "content differs").otherwise("same")
    )


def listings(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, state) of the objects (key, size, etag) of two listings, those of one side only included."""
    r = remote.select("key", F.col("size").alias("remote_size"), F.col("etag").alias("remote_etag"))
    both = local.join(r, "key", "full_outer")
    return both.select("key", object_state(F.col("size"), F.col("etag"), F.col("remote_size"), F.col("remote_etag")).alias("state"))


def present(at: DataFrame, chosen: DataFrame, edges: DataFrame, mosaic: DataFrame, cell: int) -> DataFrame:
    """(year, id, has_perimeter, has_severity) of the chosen fires (year, id), at a cell inside each.

    at: (year, id, row, col), for those that have a cell. A fire without one has neither; ids alone
    are no evidence. Perimeters are asked exactly, by containment of the cell's centre.
    """
    centre = [(F.col(c) * cell + cell / 2).alias(n) for c, n in (("col", "x"), ("row", "y"))]
    points = at.select(F.struct("year", "id").alias("pt"), *centre)
    inside = in_perimeters(points, edges).where("pt.id = id").select("pt.year", "id", F.lit(True).alias("p"))
    burned = at.join(mosaic.select("year", "row", "c0", "c1"), ["year", "row"]).where("c0 <= col and col < c1")
    burned = burned.select("year", "id", F.lit(True).alias("s")).distinct()
    rows = chosen.join(inside, ["year", "id"], "left").join(burned, ["year", "id"], "left")
    return rows.select("year", "id", F.coalesce("p", F.lit(False)).alias("has_perimeter"), F.coalesce("s", F.lit(False)).alias("has_severity"))


def distance_band(d: Column) -> Column:
    return F.when(d < BANDS[0], f"under {BANDS[0]}").when(d < BANDS[1], f"{BANDS[0]} to {BANDS[1]}").otherwise(f"{BANDS[1]} and over")


def agreement(rows: DataFrame) -> DataFrame:
    """Rows (got, want, dist) by distance band, and in all (band null): how many, how many agree."""
    by = rows.withColumn("band", distance_band(F.col("dist")))
    return by.rollup("band").agg(F.count("*").alias("n"), F.count_if(F.col("got") == F.col("want")).alias("ok"))


def mismatch_sizes(rows: DataFrame) -> DataFrame:
    return rows.where("got <> want").groupBy((F.col("got") - F.col("want")).cast("long").alias("off")).agg(F.count("*").alias("n"))


def mismatch_causes(rows: DataFrame) -> DataFrame:
    """Why rows (truth, raw, sieved, layer) disagree: the first step that changed the value."""
    cause = (
        F.when(F.col("raw") != F.col("truth"), "raster").when(F.col("sieved") != F.col("truth"), "sieve")
        .when(F.col("sieved") != F.col("layer"), "layer").otherwise("UNEXPLAINED")
    )
    return rows.where("layer <> truth").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
