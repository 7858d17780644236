"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only where it is unset and driver and tasks are one process (a local master) is it a temporary
    folder of this machine; on a cluster, whose executors would each write to a disk of their own, it
    has to be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_cinderframe_scratch", None)
        if path is None:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = spark._cinderframe_scratch = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths written in the open blocks of each thread, so that queries in two threads keep apart.
_BLOCKS = threading.local()


def _open() -> list[list[str]]:
    if not hasattr(_BLOCKS, "paths"):
        _BLOCKS.paths = []
    return _BLOCKS.paths


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the scratch folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    if _open():
        _open()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting by which an execution's shuffle files go at its end (4.1 and later; earlier ones ignore it).
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """A block in which an execution's shuffle files are removed as it ends, and not when the driver next collects garbage.

    For written() tables: a DataFrame object that is itself executed twice in the block would shuffle again.
    """
    with _LOCK:
        if not hasattr(spark, "_cinderframe_going"):  # open blocks of all threads, and the session's own setting
            spark._cinderframe_going = [0, ""]
        going = spark._cinderframe_going
        if not going[0]:
            going[1] = spark.conf.get(SHUFFLES_GO, "false")
            spark.conf.set(SHUFFLES_GO, "true")
        going[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            going[0] -= 1
            if not going[0]:
                spark.conf.set(SHUFFLES_GO, going[1])


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose written() tables are deleted at its end, but for those written by the function it gives.

    What leaves the block must not read the deleted ones. An error leaves all of them where they are.
    """
    blocks = _open()
    blocks.append([])

    def stays(df: DataFrame, name: str) -> DataFrame:
        own = blocks.pop()
        try:
            return written(df, name)
        finally:
            blocks.append(own)

    try:
        yield stays
    except BaseException:
        blocks.pop()
        raise
    for path in blocks.pop():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
