"""Approximate nearest neighbours by inner product, with multi-index hashing.

Codes. Vectors are lifted by one coordinate to a common length (so inner product orders like angle)
and turned into ``BLOCKS`` blocks of sign bits, each after a rotation learned from a bounded sample
(iterative quantisation: alternately sign the projections and solve the orthogonal Procrustes
problem). Codes are split into 8-bit substrings, each with a table of its own.

Search. Within radius R of a code, by the pigeonhole principle, some of the m substrings differs in
at most its share of R, so probing every substring's table with all values that near retrieves
every code within R; a count of the differing bits keeps those, and their original vectors give the
exact score. R is each query's own: at an angle t about ``bits * t / pi`` bits differ, give or take a
margin that the sample teaches, so once k rows are found, the k-th score says how far a code of a
better row can be. R grows by one bit a substring until it covers that (or the whole shard). Queries
with close neighbours probe few buckets; where even the nearest are at wide angles, as in vectors
without any structure, no code is ruled out by its substrings and a shard is scanned by its bit counts.

Layout. Index rows and queries are dealt into shards and blocks by hash, both bounded, and each
(block, shard) pair is one task-sized group: its k best per query are merged by rank. Queries are a
stated set, searched against all rows in blocks.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, written

K = 20
SAMPLE, TRIAL = 8_192, 512
BLOCKS = 4
ITERATIONS = 20
#: Share of the true neighbours that a radius is to hold, and of the sample's radii where searches start.
WITHIN, START = 0.985, 0.1
SHARD_ROWS, QUERY_ROWS = 16_384, 4_096
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: For each 8-bit value and each distance, the values that far, nearest first.
BY_DISTANCE = [np.argsort(POP[np.arange(256) ^ v], kind="stable") for v in range(256)]
UPTO = np.cumsum([1, 8, 28, 56, 70, 56, 28, 8, 1])
DISTANCE = POP[np.arange(256)[:, None] ^ np.arange(256)]
#: A substring's buckets are listed where they hold less than one code in so many, else told by their distance.
MANY = 16


def usable(v: Column) -> Column:
    """The vector as doubles if it takes part: not null, no null or non-finite component, not zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(d, lambda x: x != 0)
    return F.when(v.isNull() | F.coalesce(bad, F.lit(True)) | F.coalesce(zero, F.lit(True)), None).otherwise(d)


def learn_rotations(x: np.ndarray, blocks: int = BLOCKS, iterations: int = ITERATIONS) -> list[np.ndarray]:
    """Rotations of the lifted vectors, learned from different random starts."""
    out = []
    for seed in range(blocks):
        r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))
        for _ in range(iterations if len(x) else 0):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    return out


def lift(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose angles order as the inner products of queries with rows."""
    n = np.sqrt((x * x).sum(axis=1))
    if query:
        return np.concatenate((x / n[:, None], np.zeros((len(x), 1))), axis=1)
    return np.concatenate((x, np.sqrt(np.maximum(longest**2 - n**2, 0))[:, None]), axis=1) / longest


def codes_of(x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Packed sign bits, one row a vector, a whole number of bytes."""
    return np.packbits(np.concatenate([x @ r >= 0 for r in rotations], axis=1), axis=1) if len(x) else np.zeros((0, 0), np.uint8)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return POP[codes ^ code].sum(axis=1, dtype=np.int64)


def words_of(codes: np.ndarray) -> np.ndarray:
    """Codes padded to 64-bit words, to count bits by."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    padded[:, : codes.shape[1]] = codes
    return padded.view(np.uint64)


class MultiIndex:
    """One table per 8-bit substring over the distinct codes of a shard."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.owner = np.unique(codes, axis=0, return_inverse=True)
        self.owner = self.owner.reshape(-1)
        self.m, self.words, self.columns = codes.shape[1], np.ascontiguousarray(words_of(self.codes).T), np.ascontiguousarray(self.codes.T)
        self.order = [np.argsort(self.codes[:, j], kind="stable") for j in range(self.m)]
        self.start = [np.searchsorted(self.codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of the distinct codes in the buckets that a search within radius has to visit.

        The substrings' limits plus one add up to radius + 1, so a code within it can't be beyond all
        of them: ``extra`` substrings have the limit ``base``, the others one less.
        """
        base, extra = divmod(radius + 1, self.m)
        hit, left = np.zeros(len(self.codes), bool), None
        for j in range(self.m):
            limit = min(8, base if j < extra else base - 1)
            if limit < 0:
                continue
            if left is None:
                order, start = self.order[j], self.start[j]
                values = BY_DISTANCE[code[j]][: UPTO[limit]]
                begin, end = start[values], start[values + 1]
                if (end - begin).sum() * MANY < len(hit):
                    hit[np.concatenate([order[a:b] for a, b in zip(begin.tolist(), end.tolist())])] = True
                    continue
                left = np.flatnonzero(~hit)  # wide shares: the buckets' codes are looked up among those not yet visited
            if not len(left):
                break
            near = DISTANCE[code[j]][self.columns[j][left]] <= limit
            hit[left[near]] = True
            left = left[~near]
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all distinct codes within radius, by pigeonhole probing."""
        at = self.probe(code, radius)
        d = np.zeros(len(at), np.uint16)
        for column, word in zip(self.words, words_of(code[None, :])[0]):
            d += np.bitwise_count((column if len(at) == len(column) else column[at]) ^ word)
        return at[d <= radius]


class Model(NamedTuple):
    """Rotations, the longest vector, and what the sample says of radii: where to start, and the margin."""

    rotations: list
    longest: float
    start: int
    margin: float

    @property
    def bits(self) -> int:
        return 8 * -(-sum(r.shape[1] for r in self.rotations) // 8)

    def radius(self, score: float, length: float) -> int:
        """Within how many bits of a query of that length nearly all rows of at least that score are."""
        angle = math.acos(max(-1.0, min(1.0, score / (self.longest * length))))
        return min(self.bits, max(0, math.ceil(sum(r.shape[1] for r in self.rotations) * angle / math.pi + self.margin)))


def search_shard(q_ids, q, ids, x, model: Model, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of the k best found in a shard for each query, own row left out."""
    index = MultiIndex(codes_of(lift(x, model.longest, False), model.rotations))
    rows_of = np.argsort(index.owner, kind="stable")
    first = np.searchsorted(index.owner[rows_of], np.arange(len(index.codes) + 1))
    q_codes = codes_of(lift(q, model.longest, True), model.rotations)
    out = []
    for qid, vec, code in zip(q_ids.tolist(), q, q_codes):
        r, length = model.start, math.sqrt(float(vec @ vec))
        known, scored = np.zeros(len(ids), bool), np.zeros(len(ids))
        while True:
            found = index.within(code, r)
            rows = np.concatenate([rows_of[first[c] : first[c + 1]] for c in found]) if 0 < len(found) < len(index.codes) else np.arange(len(ids) if len(found) else 0)
            rows = rows[ids[rows] != qid]
            new = rows[~known[rows]]
            scored[new], known[new] = x[new] @ vec, True  # but for rounding; those that may be best get their exact score below
            score = scored[rows]
            if r >= model.bits or len(rows) >= k and model.radius(float(np.partition(score, -k)[-k]), length) <= r:
                break
            r = min(model.bits, r + index.m)
        if len(rows) > k:  # of the others none is among the k best
            rows = rows[score >= np.partition(score, -k)[-k] - 1e-10 * model.longest * length]
        score = (x[rows] * vec).sum(axis=1)
        best = np.lexsort((ids[rows], -score))[:k]
        out += [(qid, int(ids[rows[i]]), float(score[i])) for i in best]
    return out


def fit(rows: DataFrame, k: int = K, sample: int = SAMPLE) -> Model:
    """The codes' rotations and radii from at most about ``sample`` vectors, chosen by hash."""
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    n = rows.count()
    part = rows if n <= sample else rows.where(F.xxhash64("id") < F.lit(int(-(2**63) + 2**64 * sample / n)))
    x = np.array([r["v"] for r in part.select("v").limit(2 * sample).collect()], float)
    if not len(x):
        return Model([], longest, 0, 0.0)
    lifted = lift(x, longest, False)
    rotations = learn_rotations(lifted)
    codes = codes_of(lifted, rotations)
    model = Model(rotations, longest, 0, 0.0)
    trial = np.arange(0, len(x), max(1, len(x) // TRIAL))
    q_codes = codes_of(lift(x[trial], longest, True), rotations)
    off, last = [], []
    for t, code in zip(trial.tolist(), q_codes):
        s = x @ x[t]
        s[t] = -np.inf
        near = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        length = math.sqrt(float(x[t] @ x[t]))
        off += [d - model.radius(v, length) for d, v in zip(distances(codes[near], code).tolist(), s[near].tolist())]
        last += [(s[near[-1]], length)] if len(near) else []
    model = model._replace(margin=float(np.quantile(off, WITHIN)) if off else 0.0)
    start = int(np.quantile([model.radius(v, n) for v, n in last], START)) if last else 0
    return model._replace(start=start)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, nearest first.

    ``rows`` and ``queries``: (id long, v array<double>), usable vectors of one dimension. A query's
    own row (equal id) is no candidate; ties go to the smaller vec_id; with fewer than k candidates
    all are returned. Repeated rows are candidates of their own. Empty sides give no rows.
    """
    spark = rows.sparkSession
    n, nq = rows.count(), queries.count()
    model = spark.sparkContext.broadcast(fit(rows, k))  # rotations: BLOCKS x (dimension + 1)^2
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(spread.alias("block"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    spread = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    right = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), spread.alias("shard"), "id", "v")

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(q):
            x, y = np.array(a["v"].tolist(), float), np.array(q["v"].tolist(), float)
            found = search_shard(q["id"].to_numpy(), y, a["id"].to_numpy(), x, model.value, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["block", "shard"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_by_dimension(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """nearest() within each dimension: vectors of different dimensions have no inner product.

    Every dimension is fitted and searched by itself; there are few of them in a table.
    """
    dims = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    parts = [nearest(*(t.where(F.size("v") == d) for t in (rows, queries)), k) for d in dims]
    return reduce(DataFrame.unionByName, parts) if parts else nearest(rows, queries, k)


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 nearest of every vec_id divisible by 20, among all rows.

    Vectors of several dimensions are searched each among their own; a null vec_id is no row.
    """
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), usable(F.col("embedding")).alias("v"))
    rows = written(rows.where("id is not null and v is not null"), "vectors")
    return nearest_by_dimension(rows, rows.where("id % 20 = 0"))
