"""Burn counts kept as differences by bands of rows, so that a year is added or taken out where it burned alone.

A run adds one where it starts and takes one off where it ends; sums of such differences by (row, column)
can be added and subtracted. They are published by band (``sources.published``): a change reads, sums and
publishes only the bands that its runs meet, and a band that two writers change at once is a conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderframe.operators.raster import counted
from cinderframe.sources import published
from cinderframe.sources.scratch import written

#: Rows of a band.
BAND = 64


def differences(runs: DataFrame, sign: int = 1) -> DataFrame:
    """(band, row, col, d) of runs (row, c0, c1), summed by place, places without a change left out."""
    ends = F.explode(F.array(F.struct(F.col("c0").alias("col"), F.lit(sign).alias("d")), F.struct(F.col("c1").alias("col"), F.lit(-sign).alias("d")))).alias("e")
    by = runs.select(F.floor(F.col("row") / BAND).alias("band"), "row", ends).groupBy("band", "row", F.col("e.col").alias("col"))
    return by.agg(F.sum("e.d").cast("long").alias("d")).where("d <> 0")


def change(runs: DataFrame, path: str, sign: int = 1) -> int:
    """Add runs to the counts of a folder, or take out runs that were added (sign -1); the manifest's number.

    No runs change nothing. What was never added can't be told from what was: taking it out leaves counts
    below what they should be.
    """
    spark = runs.sparkSession
    base, _ = published.manifest(spark, path)
    new = written(differences(runs, sign), "differences")
    bands = {r["band"] for r in new.select("band").distinct().collect()}  # a row a band of the raster
    if not bands:
        return base
    old = published.read(spark, path, base, "band", bands)
    both = new if old is None else new.unionByName(old.select(F.col("band").cast("long").alias("band"), "row", "col", "d"))
    total = both.groupBy("band", "row", "col").agg(F.sum("d").alias("d")).where("d <> 0")
    return published.publish(total, path, sorted(bands), by="band", base=base)


def counts(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """(row, c0, c1, n) of the latest counts, or as of a manifest; None if there are none."""
    d = published.read(spark, path, number, "band")
    return None if d is None else counted(d)
