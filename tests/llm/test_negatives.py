"""Hard negatives against scoring all pairs, and the bounds of the lists."""

from __future__ import annotations

import numpy as np
import pytest

from cinderframe.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, list int, v string"


def brute(rows):
    live = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        live.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)))
    out = []
    for a, la, va in live:
        if a % 100:
            continue
        rest = [(int(va @ v), i, lab) for i, lab, v in live if len(v) == len(va)]
        for p, i in sorted(((s, i) for s, i, lab in rest if lab == la and i != a), key=lambda x: (-x[0], x[1]))[:5]:
            fits = sorted(((s, j) for s, j, lab in rest if lab != la and 30 * p <= 100 * s <= 90 * p), key=lambda x: (-x[0], x[1]))[:10]
            out += [(a, i, r, j, p, s) for r, (s, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((6, 8))
    rows = [(i, (centers[i % 6] + 0.3 * rng.standard_normal(8)).tolist(), int(i % 6 + (i % 11 == 0))) for i in range(700)]
    rows += [(1000 + i, rows[100][1], i % 10) for i in range(40)]  # equal vectors tie everywhere
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, [1.0, None] + [0.0] * 6, 1), (2003, [float("nan")] * 8, 1), (None, rows[0][1], 1)]
    rows += [(2100, [0.0] * 8, 2), (3000, [0.5, 0.25], 1), (3001, [0.5, 0.5], 1), (3002, [0.25, 0.25], 2), (3100, [], 3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, "y") for i, v, lab in rows], SCHEMA)


def test_negatives_equal_all_pairs(spark, table):
    got = negatives.mine_by_dimension(negatives.labelled(frame(spark, table)))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(table)


def test_negatives_are_the_same_for_any_lists(spark, table):
    rows = negatives.labelled(frame(spark, table)).where("size(v) = 8")
    want = [r for r in brute(table) if r[0] < 3000]
    for kw in ({"rows_each": 20, "list_rows": 16}, {"rows_each": 60, "first": 1}):
        assert sorted(tuple(r) for r in negatives.mine(rows, **kw).collect()) == want


def test_bounds_hold_every_row_and_skip_far_lists(spark, table):
    rows = negatives.labelled(frame(spark, table)).where("size(v) = 8")
    found, lists = negatives.build(rows, 10_000, 60)
    data = found.collect()
    x, at = np.array([r["v"] for r in data]), np.array([r["list"] for r in data])
    least, most = lists.bounds(x[:50])
    score = x[:50] @ x.T
    assert (score >= least[:, at]).all() and (score <= most[:, at]).all()
    kth = np.sort(score, axis=1)[:, -10]
    assert (most < kth[:, None]).mean() > 0.3


def test_negatives_of_nothing(spark, table):
    assert negatives.mine_by_dimension(negatives.labelled(frame(spark, table[:5]).limit(0))).count() == 0
    assert negatives.mine_by_dimension(negatives.labelled(frame(spark, [(100, [1.0, 2.0], 1)]))).count() == 0
