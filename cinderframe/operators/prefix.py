"""Running sums and next rows on two levels, so that one long line is not one task's window.

Rows are range-partitioned by line and order into blocks of about equal size. Windows run inside a
block; what crosses a block's border is one row a line and block, and windows over those carry totals
and next rows from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinderframe.sources.scratch import written

BLOCK = "__block"


def blocked(rows: DataFrame, line: list[str], order: str, blocks: int | None = None) -> DataFrame:
    """Rows with their block's number: blocks follow (line, order), and a line may lie in many.

    Written, so that the numbers are the same for all who read them.
    """
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *line, order).withColumn(BLOCK, F.spark_partition_id()), "blocked-lines")


def with_next(rows: DataFrame, line: list[str], order: str, **values: str) -> DataFrame:
    """Blocked rows with columns of the next row of their line: name=column; null at the line's end."""
    inside = W.partitionBy(BLOCK, *line).orderBy(order)
    firsts = rows.groupBy(*line, BLOCK).agg(F.min(F.struct(order, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(values.values())])).alias("__first"))
    after = firsts.select(*line, BLOCK, F.lead("__first").over(W.partitionBy(*line).orderBy(BLOCK)).alias("__after"))
    out = rows.withColumn("__last", F.lead(F.lit(False), 1, True).over(inside))
    for name, column in values.items():
        out = out.withColumn(f"__n_{name}", F.lead(column).over(inside))
    out = out.join(after, [*line, BLOCK], "left")
    for i, name in enumerate(values):
        out = out.withColumn(name, F.when(F.col("__last"), F.col("__after")[f"__v{i}"]).otherwise(F.col(f"__n_{name}"))).drop(f"__n_{name}")
    return out.drop("__last", "__after")


def with_sum_before(rows: DataFrame, line: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Blocked rows with the sum of ``value`` over the rows of their line in front of them; 0 at the start, nulls count 0."""
    rows = rows.withColumn("__value", F.coalesce(value, F.lit(0.0)))
    totals = rows.groupBy(*line, BLOCK).agg(F.sum("__value").alias("__total"))
    front = W.partitionBy(*line).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*line, BLOCK, F.coalesce(F.sum("__total").over(front), F.lit(0.0)).alias("__carried"))
    inside = W.partitionBy(BLOCK, *line).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("__here", F.coalesce(F.sum("__value").over(inside), F.lit(0.0))).join(carried, [*line, BLOCK])
    return out.withColumn(name, F.col("__carried") + F.col("__here")).drop("__value", "__here", "__carried")
