"""Published years: written aside, audited, then named in a manifest that readers resolve.

A dataset's folder holds ``data/<token>/year=...``, never changed once named, and ``manifests/<number>.json``,
which say where each year is and how many rows it has. A commit is the renaming of the next manifest's
file into place, which fails if that number is taken: of two writers one wins, and the other reads the
winner's manifest and tries the next number, unless one of its own years was published meanwhile. A
writer that dies before leaves a folder that no manifest names, so readers never see half a year and two
builds never mix.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer published one of these years since this one began."""


class Rejected(Exception):
    """What was written is not what was meant."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[int, dict]]:
    """(number, year -> {folder, rows, version}) of the latest or a given manifest; (0, {}) if there is none."""
    number = number if number is not None else max(_numbers(spark, path), default=0)
    if not number:
        return 0, {}
    text = spark.read.text(f"{path}/manifests/{number:08d}.json", wholetext=True).first()[0]
    return number, {int(y): v for y, v in json.loads(text).items()}


def read(spark: SparkSession, path: str, number: int | None = None, by: str = "year", only: set[int] | None = None) -> DataFrame | None:
    """The years that a manifest names (or those of them in ``only``), each with its ``year``; None if there are none."""
    years = {y: v for y, v in manifest(spark, path, number)[1].items() if only is None or y in only}
    parts: dict[str, list[int]] = {}
    for y, v in years.items():
        parts.setdefault(v["folder"], []).append(y)
    out = None
    for folder, own in sorted(parts.items()):
        part = spark.read.parquet(f"{path}/data/{folder}").where(F.col(by).isin(own))
        out = part if out is None else out.unionByName(part)
    return out


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether a file got the name; never over another file."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at, to = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(at, to, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def staged(df: DataFrame, path: str, by: str = "year") -> tuple[str, dict[int, int]]:
    """(folder, rows of each year) of df written aside and read back; Rejected if rows got lost on the way."""
    spark, folder, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(by).parquet(f"{path}/data/{folder}")
    rows = {}
    if seen.get["n"]:
        back = spark.read.parquet(f"{path}/data/{folder}").groupBy(by).count().collect()  # a row a year
        rows = {int(r[by]): r["count"] for r in back if r[by] is not None}
    if sum(rows.values()) != seen.get["n"]:
        raise Rejected(f"{seen.get['n']} rows written, {sum(rows.values())} found in years")
    return folder, rows


def publish(df: DataFrame, path: str, years: list[int] | None = None, audit: Callable[[DataFrame], str | None] | None = None, staged_hook: Callable[[], None] | None = None, by: str = "year", base: int | None = None) -> int:
    """Publish df's years (and empty ``years``, which are then gone) as the next manifest; its number.

    ``by``: the column of whole numbers that takes the part of the year. ``base``: the manifest that df was
    made from, if from one; else the latest when this call begins.
    ``audit`` looks at what was written and names a problem, or None. A year that another writer published
    since this call began is a Conflict, other years of other writers stay. Nothing is visible until the end.
    """
    spark = df.sparkSession
    before = manifest(spark, path, base)[1]
    folder, rows = staged(df, path, by)
    problem = audit(spark.read.parquet(f"{path}/data/{folder}")) if audit and rows else None
    if problem:
        raise Rejected(problem)
    if staged_hook:
        staged_hook()
    mine = set(rows) | set(years or ())
    while True:
        number, now = manifest(spark, path)
        if changed := sorted(y for y in mine if now.get(y) != before.get(y)):
            raise Conflict(f"years {changed} were published meanwhile")
        new = {y: v for y, v in now.items() if y not in mine}
        new |= {y: {"folder": folder, "rows": n, "version": number + 1} for y, n in rows.items()}
        aside = f"{path}/manifests/.{uuid.uuid4().hex}"
        _write_text(spark, aside, json.dumps({str(y): new[y] for y in sorted(new)}))
        if _renamed(spark, aside, f"{path}/manifests/{number + 1:08d}.json"):
            return number + 1
        fs, p = _fs(spark, aside)
        fs.delete(p, False)


def swept(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Folders that none of the last ``keep`` manifests names, deleted. Only while no writer is at work."""
    named = {v["folder"] for n in _numbers(spark, path)[-keep:] for v in manifest(spark, path, n)[1].values()}
    fs, p = _fs(spark, f"{path}/data")
    gone = sorted({s.getPath().getName() for s in fs.listStatus(p)} - named) if fs.exists(p) else []
    for name in gone:
        fs.delete(_fs(spark, f"{path}/data/{name}")[1], True)
    return gone
