"""The repeat-burn product: from burn counts to outlines in degrees, with their count and acres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.scalar import acres
from cinderframe.operators import geom, raster, rings
from cinderframe.operators.labels import label_components
from cinderframe.sources.scratch import written

#: Cells that a patch has at least, metres that simplification may move a line, and decimals of a degree.
SIEVE, SIMPLIFY, DECIMALS = 16, 90.0, 4


def repeat_patches(counts: DataFrame, least: int = SIEVE, eps: float = SIMPLIFY, cell: int = raster.CELL) -> DataFrame:
    """(patch, count, acres, geom) of burn-count runs (row, c0, c1, n): ground burned twice or more.

    Specks are sieved, single burns masked out, the rest outlined per region of one count. Acres are the
    cells', taken before simplification moves a corner; outlines are simplified in metres, then put in
    degrees. A patch is one part, its outline and then its holes; where simplification leaves a hole without
    three corners it is dropped, an outline then stays as it was.
    """
    sieved = raster.sieve(counts, least).where("n >= 2")
    lab = written(label_components(sieved), "product-labels")
    size = lab.groupBy("comp", "n").agg(F.sum(F.col("c1") - F.col("c0")).alias("cells"))
    shape = rings.shapes(rings.rings(lab), cell).repartition("comp", "ring").withColumn("thin", F.col("pts"))
    shape = geom.simplified(shape, eps, "thin").where("area > 0 or size(thin) >= 4")
    shape = shape.withColumn("pts", F.when(F.size("thin") >= 4, F.col("thin")).otherwise(F.col("pts")))
    # degrees of all corners at once, then rings again
    corner = shape.select("comp", "ring", (F.col("area") < 0).alias("hole"), F.posexplode("pts").alias("i", "p"))
    place = geom.albers_inverse(F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    point = corner.withColumn("d", place).select("comp", "ring", "hole", F.struct("i", F.struct(F.round("d.lon", DECIMALS).alias("x"), F.round("d.lat", DECIMALS).alias("y")).alias("p")).alias("q"))
    ring = point.groupBy("comp", "ring", "hole").agg(F.transform(F.sort_array(F.collect_list("q")), lambda q: q["p"]).alias("pts"))
    part = ring.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("hole", "ring", "pts"))).alias("r"))
    whole = part.select("comp", F.array(F.transform("r", lambda r: r["pts"])).alias("geom"))
    area = F.round(acres(F.col("cells") * (cell * cell))).cast("long").alias("acres")
    return size.join(whole, "comp").select(F.col("comp").alias("patch"), F.col("n").alias("count"), area, "geom")
