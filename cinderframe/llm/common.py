"""Shared pieces of the training-data operators: tables in the shared folder, and bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderframe.sources.scratch import fresh_path, passing_shuffles, passing_tables, written  # noqa: F401


#: Settings of batches that go to Python: name -> (Spark's default, ours). Whichever is met first ends a batch.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608"),
}


def short_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches that bound a worker's memory, unless the session says how.

    The settings stay: a query's last stage runs after its function has returned.
    """
    for name, (usual, ours) in BATCHES.items():
        now = spark.conf.get(name, usual)
        if now in (usual, f"{usual}b", "64m", "64MB"):
            spark.conf.set(name, ours)


_HELD: dict = {}


def held(key, build):
    """``build()``, kept by this Python worker until it asks for the value of another key.

    Workers outlive stages, so one large object (a model, an encoder) at a time bounds their memory;
    held(None, ...) lets go of it. What the last one took is given back to the system first.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = build()
    return _HELD[key]


def give_back() -> None:
    """Freed memory of this process back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def nullable(values: pd.Series, null: pd.Series) -> pd.arrays.IntegerArray:
    """Whole numbers of a batch with nulls where ``null``; pandas would read a nullable long as a double."""
    return pd.arrays.IntegerArray(values.to_numpy(np.int64), null.to_numpy(bool, copy=True))


def whole_ids(column: str = "doc_id") -> list[Column]:
    """Two columns for nullable(): ``column`` (0 for null) and no_id."""
    return [F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")).alias(column), F.col(column).isNull().alias("no_id")]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` (already written) has at most ``rows`` rows, a bound for broadcasting it."""
    return df.limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join that broadcasts ``right`` only if it is proven to have at most ``rows`` rows."""
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)
