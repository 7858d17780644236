"""Nearest neighbours: recall against all pairs, exact probing, pruning where there is structure, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.llm import ann
from cinderframe.llm.common import written


def vectors(spark, data):
    d = spark.createDataFrame(data, "id long, e array<float>").select("id", ann.usable(F.col("e")).alias("v")).where("id is not null and v is not null")
    return written(d, "v")


def by_query(found):
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def recall(got, x, k):
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:k]
        hit += len({v for v, _ in found} & set(want.tolist()))
        assert len(found) == k and all(abs(v - s[i]) < 1e-9 for i, v in found)
        assert [i for i, _ in found] == [i for i, _ in sorted(found, key=lambda p: (-round(p[1], 12), p[0]))]
    return hit / (k * len(got))


@pytest.mark.parametrize("shard,block", [(16384, 4096), (150, 7)])
def test_recall_ties_and_unusable_vectors(spark, shard, block):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).astype("float32")
    x[50:90] = x[50]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (None, x[0].tolist()), (1060, [None] * 16)]
    d = vectors(spark, data)
    got = by_query(ann.nearest(d, d.where("id % 20 = 0"), 20, shard, block))
    assert set(got) == set(range(0, 600, 20)) and recall(got, x.astype(float), 20) >= 0.9
    two = written(d.where("id < 2"), "v2")
    assert ann.nearest(two, two.where("id = 0"), 20).count() == 1
    none = written(d.where("id < 0"), "v3")
    assert ann.nearest(none, none).count() == 0 and ann.nearest_by_dimension(none, none).count() == 0


def test_multi_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 256, (300, 4), dtype=np.uint8)
    index = ann.MultiIndex(codes)
    for q in codes[:20]:
        for r in (0, 3, 7, 12):
            want = np.flatnonzero(ann.distances(index.codes, q) <= r)
            assert index.within(q, r).tolist() == want.tolist() and set(want.tolist()) <= set(index.probe(q, r).tolist())


def test_probing_visits_few_codes_where_neighbours_are_close(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((120, 32))
    x = (centres[np.arange(3000) % 120] + 0.04 * rng.standard_normal((3000, 32)))
    x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype("float32")
    d = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    model = ann.fit(d, 10)
    share, probe = [], ann.MultiIndex.probe

    def seen(self, code, radius):
        at = probe(self, code, radius)
        share.append(len(at) / len(self.codes))
        return at

    monkeypatch.setattr(ann.MultiIndex, "probe", seen)
    ids = np.arange(3000)
    y = x.astype(float)
    got: dict = {}
    for q, i, s in ann.search_shard(ids[::20], y[::20], ids, y, model, 10):
        got.setdefault(q, []).append((i, s))
    assert recall(got, y, 10) >= 0.9 and np.mean(share) < 0.1


def test_vectors_of_each_dimension_are_searched_among_their_own(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = [(i, rng.standard_normal(8 if i % 3 else 5).astype("float32").tolist(), 0) for i in range(240)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = by_query(ann.op4_multi_index_hashing(spark, str(tmp_path)))
    assert set(got) == set(range(0, 240, 20))
    for q, found in got.items():
        own = {i for i, v, _ in data if len(v) == len(data[q][1]) and i != q}
        assert len(found) == 20 and {i for i, _ in found} <= own


def test_probing_wide_shares_visits_the_same_codes_and_scores_each_row_once(monkeypatch):
    rng = np.random.default_rng(17)
    codes = rng.integers(0, 256, (700, 6), dtype=np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 5, 6, 9, 14, 20, 31, 48):
        base, extra = divmod(radius + 1, 6)
        limits = [base if j < extra else base - 1 for j in range(6)]
        for code in codes[:5]:
            far = ann.POP[index.codes ^ code]
            assert index.probe(code, radius).tolist() == np.flatnonzero((far <= np.array(limits)).any(axis=1)).tolist()
            assert index.within(code, radius).tolist() == np.flatnonzero(far.sum(axis=1, dtype=int) <= radius).tolist()

    class Counted(np.ndarray):
        taken = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and self.ndim == 2:
                Counted.taken += len(at)
            return super().__getitem__(at)

    x = rng.standard_normal((900, 16))
    rotations = ann.learn_rotations(ann.lift(x, 9.0, False), 2, 2)
    model = ann.Model(rotations, 9.0, 4, 6.0)
    got = ann.search_shard(np.arange(20), x[:20], np.arange(900), x.view(Counted), model, 5)
    assert len(got) == 100 and Counted.taken <= 20 * (900 + 5)  # and the best once more, exactly
