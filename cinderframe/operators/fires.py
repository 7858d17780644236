"""Fires: filters, severity tags, yearly totals, and reconciliation of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinderframe.functions.scalar import WEST, age_opacity, state, whole_half_even

CLASSES = (1, 2, 3, 4, 5)


def western(fires: DataFrame, states=WEST) -> DataFrame:
    return fires.where(state(F.col("id")).isin(*states))


def dated(fires: DataFrame, first: str, last: str) -> DataFrame:
    """Fires that began in a range of dates, both ends included; undated fires drop out."""
    return fires.where(F.col("ig_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def with_year(fires: DataFrame) -> DataFrame:
    return fires.withColumn("year", F.year("ig_date"))


def season(fires: DataFrame, year: int) -> DataFrame:
    return fires.where(F.col("year") == year)


def up_to(fires: DataFrame, year: int) -> DataFrame:
    return fires.where(F.col("year") <= year)


def drawable(stats: DataFrame) -> DataFrame:
    """Pixel counts of classes that are drawn: neither nodata (0) nor masked (6)."""
    return stats.where(F.col("class").between(CLASSES[0], CLASSES[-1]))


def class_percents(stats: DataFrame) -> DataFrame:
    """(id, sev): percent of mapped pixels in each class, each rounded half-even; unmapped fires drop out."""
    px = [F.sum(F.when(F.col("class") == c, F.col("px")).otherwise(0)).alias(f"c{c}") for c in CLASSES]
    mapped = sum((F.col(f"c{c}") for c in CLASSES[1:]), F.col("c1"))
    return drawable(stats).groupBy("id").agg(*px).where(mapped > 0).select("id", F.array(*[whole_half_even(100.0 * F.col(f"c{c}") / mapped).cast("int") for c in CLASSES]).alias("sev"))


def tag_severity(fires: DataFrame, stats: DataFrame) -> DataFrame:
    """fires with sev (null where unmapped) and sev_ok; every fire stays."""
    return fires.join(class_percents(stats), "id", "left").withColumn("sev_ok", F.col("sev").isNotNull())


def year_summary(tagged: DataFrame) -> DataFrame:
    """(year, fires, acres, sev): missing acres count 0, the fire still counts."""
    acres = whole_half_even(F.sum(F.coalesce(F.col("acres").cast("double"), F.lit(0.0))))
    return tagged.groupBy("year").agg(F.count("*").alias("fires"), acres.alias("acres"), F.count_if("sev_ok").alias("sev"))


def accumulated(summary: DataFrame) -> DataFrame:
    """Year totals with fires and acres up to each year; a row a year, so one window holds them."""
    upto = W.orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    return summary.select("year", "fires", "acres", "sev", F.sum("fires").over(upto).alias("fires_to"), F.sum("acres").over(upto).alias("acres_to"))


def severity_status(tagged: DataFrame) -> DataFrame:
    """Why a fire has no severity: its whole old year has none, or it is too recent to be mapped.

    Fires of the newest year or of years after the last fully mapped season are "not yet mapped".
    """
    years = tagged.groupBy("year").agg(F.count_if("sev_ok").alias("n_ok"), F.count("*").alias("n"))
    newest = years.agg(F.max("year").alias("newest"))
    rows = tagged.join(F.broadcast(years), "year").join(F.broadcast(newest))  # 41 rows, 1 row
    status = F.when(F.col("sev_ok"), "mapped").when(F.col("year") == F.col("newest"), "not yet mapped").when(F.col("n_ok") == 0, "not available").otherwise("unmapped")
    return rows.select("id", "year", "sev_ok", status.alias("status"))


def fires_by_state(fires: DataFrame) -> DataFrame:
    return fires.groupBy(state(F.col("id")).alias("state")).agg(F.count("*").alias("fires"))


def coverage_by_period(tagged: DataFrame, split: int) -> DataFrame:
    """Fires and mapped fires up to a year, after it, and in all (period null)."""
    period = F.when(F.col("year") <= split, F.lit(f"to {split}")).otherwise(F.lit(f"after {split}"))
    return tagged.withColumn("period", period).rollup("period").agg(F.count("*").alias("fires"), F.count_if("sev_ok").alias("sev"))


def largest_of_each_year(fires: DataFrame) -> DataFrame:
    """The fire with most acres in each year (missing acres are 0), ties to the smaller id."""
    acres = F.coalesce(F.col("acres").cast("double"), F.lit(0.0))
    best = fires.groupBy("year").agg(F.max(acres).alias("most"))  # a row a year: no window over a year's fires
    top = fires.join(F.broadcast(best), "year").where(acres == F.col("most"))
    return top.groupBy("year").agg(F.min("id").alias("id"), F.max("most").alias("acres"))


def missing_years(first: int, last: int, held: DataFrame) -> DataFrame:
    """Years of a range without a held mosaic."""
    years = held.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(held.select("year").distinct(), "year", "left_anti")


def landing_problem(url: Column, code: Column, size: Column, n_rasters: Column, least: int = 100_000) -> Column:
    """Why a year has no mosaic, the first reason that holds; null if there is none."""
    return (
        F.when(url.isNull(), "no url").when(~code.isin(200, 206), F.concat(F.lit("http "), code.cast("string")))
        .when(size < least, "archive too small").when(n_rasters == 0, "no raster inside")
    )


def expected_severity(summary: DataFrame, gaps: tuple[int, ...]) -> DataFrame:
    """Years with fires against years with severity: OK, WARN for known gaps, FAIL for the rest."""
    known = F.col("year").isin(*gaps) if gaps else F.lit(False)
    return summary.select("year", "fires", "sev", F.when(F.col("sev") > 0, "OK").when(known, "WARN").otherwise("FAIL").alias("state"))


def age_expansion(summary: DataFrame) -> DataFrame:
    """(frame, year, fires, opacity) for every fire year up to each frame year: tables of a row a year."""
    frames = F.broadcast(summary.select(F.col("year").alias("frame")))
    rows = summary.join(frames, F.col("year") <= F.col("frame"))
    return rows.select("frame", "year", "fires", F.round(age_opacity(F.col("frame") - F.col("year")), 6).alias("opacity"))
