"""Counts changed by bands against counting all runs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from cinderframe.operators import increments, raster
from cinderframe.sources import published


def cells_of(df):
    out = Counter()
    for r in df.collect():
        for c in range(r["c0"], r["c1"]):
            out[r["row"], c] += r["n"]
    return out


def test_counts_follow_what_is_added_and_taken_out(spark, tmp_path):
    path = f"file://{tmp_path}/counts"
    rng = random.Random(2)
    frame = lambda rows: spark.createDataFrame(rows, "row long, c0 long, c1 long")
    parts = {}
    for year, low in ((1, -70), (2, 0), (3, 150)):
        parts[year] = [(rng.randint(low, low + 80), a, a + rng.randint(1, 30)) for a in (rng.randint(-20, 60) for _ in range(60))]
    assert increments.counts(spark, path) is None
    for year in (1, 2, 3):
        increments.change(frame(parts[year]), path)
    assert cells_of(increments.counts(spark, path)) == cells_of(raster.sweep(frame(parts[1] + parts[2] + parts[3])))
    before = published.manifest(spark, path)
    increments.change(frame(parts[3]), path, -1)
    after = published.manifest(spark, path)
    touched = {r // increments.BAND for r, _, _ in parts[3]}
    assert {b for b, v in after[1].items() if v != before[1].get(b)} | (set(before[1]) - set(after[1])) == touched
    assert cells_of(increments.counts(spark, path)) == cells_of(raster.sweep(frame(parts[1] + parts[2])))
    assert cells_of(increments.counts(spark, path, before[0])) == cells_of(raster.sweep(frame(parts[1] + parts[2] + parts[3])))
    assert increments.change(frame(parts[1]).limit(0), path) == after[0]
    for year in (1, 2):
        increments.change(frame(parts[year]), path, -1)
    assert increments.counts(spark, path) is None


def test_two_changes_of_a_band_conflict(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/counts"
    frame = lambda *rows: spark.createDataFrame(list(rows), "row long, c0 long, c1 long")
    increments.change(frame((0, 0, 5)), path)
    publish = published.publish

    def late(df, at, *args, **kw):
        monkeypatch.setattr(published, "publish", publish)
        increments.change(frame((1, 0, 5)), path)  # another writer is first
        return publish(df, at, *args, **kw)

    monkeypatch.setattr(published, "publish", late)
    with pytest.raises(published.Conflict):
        increments.change(frame((2, 0, 5)), path)
    assert set(cells_of(increments.counts(spark, path))) == {(r, c) for r in (0, 1) for c in range(5)}
