"""Hard-negative mining over k-means inverted lists.

Lists. Centroids are fitted on a bounded sample; every row then joins the list of its nearest
centroid, and a list's radius is the largest distance of its rows from the centroid. By the
Cauchy-Schwarz inequality every row of a list scores within ``|q| * radius`` of the anchor's score
with the centroid, so a list is visited only if it can hold a row of the wanted window of scores,
best bound first; once an anchor has its k rows, lists whose bound falls strictly below the kth
score stay unvisited (ties could still be there at an equal bound).

Visits run in two waves over the whole cluster: every anchor's ``FIRST`` best lists give a kth score,
then all lists whose bound reaches it. A list of more than ``LIST_ROWS`` rows is cut into pieces by
hash, and anchors meet a piece ``ANCHORS`` at a time, so a task is bounded however uneven the lists
are; rows travel once a block of anchors that visits them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, written

POSITIVES, NEGATIVES = 5, 10
LABELS, WRONG_EVERY, ANCHOR_EVERY = 10, 7, 100
SCALE = 256
#: The window: LOW * positive_score <= 100 * negative_score <= HIGH * positive_score.
LOW, HIGH = 30, 90
#: Vectors that the centroids are fitted on, rounds of it, most centroids, and rows a centroid.
SAMPLE, ROUNDS, CENTROIDS, ROWS_EACH = 16_384, 8, 1_024, 2_048
LIST_ROWS, ANCHORS, FIRST = 16_384, 1_024, 2


def whole(v: Column) -> Column:
    """floor(256 * x) of each component as a double; null if the vector can't take part."""
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | F.coalesce(bad, F.lit(True)), None).otherwise(F.transform(d, lambda x: F.floor(F.lit(float(SCALE)) * x).cast("double")))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a with rows of b: by doubles where they are exact, else 64-bit integers."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Lists(NamedTuple):
    """Centroids, the radius of each list (below zero if it is empty) and its pieces."""

    centroids: np.ndarray
    radius: np.ndarray
    pieces: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, distance) of each vector's nearest centroid."""
        square = (self.centroids**2).sum(axis=1) - 2 * (x @ self.centroids.T)
        at = square.argmin(axis=1)
        return at, np.sqrt(((x - self.centroids[at]) ** 2).sum(axis=1))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score that any row of each list can have with each vector, a rounding error wider."""
        middle = x @ self.centroids.T
        reach = np.sqrt((x * x).sum(axis=1))[:, None] * np.maximum(self.radius, 0)[None, :]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack


def fit(rows: DataFrame, n: int, rows_each: int = ROWS_EACH, sample: int = SAMPLE) -> np.ndarray:
    """Centroids from at most about ``sample`` vectors, chosen by hash; the same on every run."""
    part = rows if n <= sample else rows.where(F.xxhash64("id") < F.lit(int(-(2**63) + 2**64 * sample / n)))
    x = np.array([r["v"] for r in part.orderBy("id").limit(2 * sample).select("v").collect()], float)
    k = max(1, min(CENTROIDS, len(x), -(-n // rows_each)))
    centroids = x[np.random.default_rng(0).choice(len(x), k, replace=False)] if len(x) else np.zeros((1, 1))
    for _ in range(ROUNDS if len(x) else 0):
        near, _ = Lists(centroids, np.zeros(0), np.zeros(0)).nearest(x)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        many = np.bincount(near, minlength=k)
        centroids = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centroids)
    return centroids


def build(rows: DataFrame, list_rows: int = LIST_ROWS, rows_each: int = ROWS_EACH) -> tuple[DataFrame, Lists]:
    """(rows with ``list``, written; Lists) of rows (id, label, v), every row in its nearest list."""
    spark = rows.sparkSession
    n = rows.count()
    start = Lists(fit(rows, n, rows_each), np.zeros(0), np.zeros(0))
    shared = spark.sparkContext.broadcast(start)  # at most CENTROIDS vectors

    def nearest(v: pd.Series) -> pd.DataFrame:
        at, far = shared.value.nearest(np.array(v.tolist(), float)) if len(v) else (np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"list": at, "far": far})

    found = rows.withColumn("l", F.pandas_udf(nearest, "list int, far double")("v"))
    found = written(found.select("id", "label", "v", "l.list", "l.far"), "inverted-lists")
    radius, many = np.full(len(start.centroids), -1.0), np.zeros(len(start.centroids), np.int64)
    for r in found.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row a centroid
        radius[r["list"]], many[r["list"]] = r["far"], r["n"]
    return found.drop("far"), Lists(start.centroids, radius, np.maximum(1, -(-many // list_rows)))


def visit_bounds(ask: DataFrame, lists: Lists) -> DataFrame:
    """(id, pos, list, most): the lists that can hold rows of each request's window, with their bound.

    ask: (id, label, v, pos, low, high): scores from low to high are wanted, as doubles.
    """
    shared = ask.sparkSession.sparkContext.broadcast(lists)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            least, most = shared.value.bounds(np.array(b["v"].tolist(), float))
            fits = (most >= b["low"].to_numpy()[:, None]) & (least <= b["high"].to_numpy()[:, None]) & (shared.value.radius >= 0)
            at, where = np.nonzero(fits)
            # a row's bound within the window is the window's own upper end at most
            bound = np.minimum(most[at, where], b["high"].to_numpy()[at])
            yield pd.DataFrame({"id": b["id"].to_numpy()[at], "pos": b["pos"].to_numpy()[at], "list": where, "most": bound})

    return ask.select("id", "v", "pos", "low", "high").mapInPandas(run, "id long, pos long, list int, most double")


def visit(found: DataFrame, ask: DataFrame, visits: DataFrame, lists: Lists, same: bool, k: int, anchors: int = ANCHORS) -> DataFrame:
    """(id, pos, other, score): each request's k best rows of the lists it visits.

    same: rows of the request's label are wanted (another row than itself), else rows of other labels.
    visits: (id, pos, list).
    """
    spark = found.sparkSession
    cuts = spark.createDataFrame(list(enumerate(lists.pieces.tolist())), "list int, pieces long")  # a row a centroid
    cuts = F.broadcast(cuts)
    pieces = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    mine = found.join(cuts, "list").select("list", pieces.alias("piece"), F.lit(None).cast("int").alias("block"), "id", "label", "v")
    n = visits.groupBy("list").agg(F.count_distinct("id").alias("n"))
    blocks = F.broadcast(written(n.select("list", F.ceil(F.col("n") / anchors).cast("int").alias("blocks")), "visit-blocks"))  # a row a centroid
    mine = mine.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    theirs = visits.join(ask.select("id", "pos", "label", "v", "low", "high"), ["id", "pos"]).join(blocks, "list").join(cuts, "list")
    theirs = theirs.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    theirs = theirs.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)))
    theirs = theirs.select("list", "piece", "block", "id", "pos", "label", "v", "low", "high")

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(q):
            a = a.sort_values("id", kind="stable")
            x, ids, labels = np.array(a["v"].tolist(), float), a["id"].to_numpy(), a["label"].to_numpy()
            for key, group in q.groupby("id", sort=False):
                score = product(np.array([group["v"].iloc[0]], float), x)[0]
                fits = (labels == group["label"].iloc[0]) & (ids != key) if same else labels != group["label"].iloc[0]
                order = np.flatnonzero(fits)
                order = order[np.argsort(-score[order], kind="stable")]
                ranked = -score[order]
                for pos, low, high in zip(group["pos"].tolist(), group["low"].tolist(), group["high"].tolist()):
                    top, end = np.searchsorted(ranked, -np.floor(high) if high < 2.0**62 else -(2**62), "left"), np.searchsorted(ranked, -np.ceil(low) if low > -(2.0**62) else 2**62, "right")
                    best = order[top : min(end, top + k)]
                    out += [(key, pos, int(ids[i]), int(score[i])) for i in best]
        return pd.DataFrame(out, columns=["id", "pos", "other", "score"])

    keys = ["list", "piece", "block"]
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(run, "id long, pos long, other long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("id", "pos").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(found: DataFrame, ask: DataFrame, lists: Lists, same: bool, k: int, first: int = FIRST) -> DataFrame:
    """(id, pos, other, score, rank): each request's k best rows of its window, in two waves of visits."""
    bounds = written(visit_bounds(ask, lists), "list-bounds")
    order = W.partitionBy("id", "pos").orderBy(F.desc("most"), "list")
    turn = written(bounds.withColumn("turn", F.row_number().over(order)), "list-turns")
    one = written(ranked(visit(found, ask, turn.where(F.col("turn") <= first).select("id", "pos", "list"), lists, same, k), k), "first-visits")
    kth = one.where(F.col("rank") == k).select("id", "pos", F.col("score").alias("kth"))
    rest = turn.where(F.col("turn") > first).join(kth, ["id", "pos"], "left").where("kth is null or most >= kth")
    rest = written(rest.select("id", "pos", "list"), "later-visits")
    two = visit(found, ask, rest, lists, same, k)
    return ranked(one.drop("rank").unionByName(two), k)


def mine(rows: DataFrame, anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, list_rows: int = LIST_ROWS, rows_each: int = ROWS_EACH, first: int = FIRST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (id, label, v).

    ``v``: whole numbers as doubles, all of one dimension. Anchors (default: every hundredth id) get their
    ``positives`` best other rows of their label, and for each of them the ``negatives`` best rows of other
    labels whose score lies in the window. Ties go to the smaller id. A row with an anchor's own id is no
    other row; repeated rows are rows of their own. With fewer rows all are returned, without any none.
    """
    anchors = F.col("id") % ANCHOR_EVERY == 0 if anchors is None else anchors
    found, lists = build(rows, list_rows, rows_each)
    ask = found.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    everything = ask.select("id", "label", "v", F.lit(0).cast("long").alias("pos"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    near = written(best_rows(found, written(everything, "anchors"), lists, True, positives, first), "positives")
    window = near.join(ask, "id").select(
        "id", "label", "v", F.col("rank").cast("long").alias("pos"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"),
        (F.ceil(F.col("score") * LOW / 100.0)).cast("double").alias("low"), (F.floor(F.col("score") * HIGH / 100.0)).cast("double").alias("high"),
    ).where("low <= high")
    window = written(window, "windows")
    far = best_rows(found, window.drop("positive_id", "positive_score"), lists, False, negatives, first)
    out = far.join(window.select("id", "pos", "positive_id", "positive_score"), ["id", "pos"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_by_dimension(rows: DataFrame) -> DataFrame:
    """mine() within each dimension: vectors of different dimensions have no inner product."""
    dims = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())  # few
    return reduce(DataFrame.unionByName, [mine(rows.where(F.size("v") == d)) for d in dims]) if dims else mine(rows)


def labelled(embeddings: DataFrame) -> DataFrame:
    """(id, label, v) of the rows that take part, with each seventh label moved on by one."""
    moved = F.when(F.col("vec_id") % WRONG_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), moved.cast("long").alias("label"), whole(F.col("embedding")).alias("v"))
    return rows.where("id is not null and label is not null and v is not null")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over all of embeddings."""
    return mine_by_dimension(written(labelled(read_table(spark, sf_dir, "embeddings")), "labelled"))


#: The contract in SQL, with all scores of the anchors.
ORACLE_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id % 100 = 0 AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE alike AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INT AS rank,
    s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
