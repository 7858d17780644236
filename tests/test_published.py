"""Published years: broken and concurrent writers, audits, and what readers see."""

from __future__ import annotations

import pytest

from cinderframe.sources import published


def years(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, year int")


def seen(spark, path, number=None):
    return sorted(tuple(r) for r in published.read(spark, path, number).select("id", "year").collect())


def test_readers_see_whole_years_whatever_writers_do(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    assert published.read(spark, path) is None and published.manifest(spark, path) == (0, {})
    assert published.publish(years(spark, ("a", 2001), ("b", 2001), ("c", 2002)), path) == 1
    published.staged(years(spark, ("broken", 2001)), path)  # a writer that was killed before its commit
    assert seen(spark, path) == [("a", 2001), ("b", 2001), ("c", 2002)]
    assert published.publish(years(spark, ("d", 2002), ("e", 2003)), path) == 2
    assert seen(spark, path) == [("a", 2001), ("b", 2001), ("d", 2002), ("e", 2003)] and seen(spark, path, 1)[-1] == ("c", 2002)
    assert published.publish(years(spark, ("x", 2009)).limit(0), path, years=[2001]) == 3
    assert seen(spark, path) == [("d", 2002), ("e", 2003)]
    assert len(published.swept(spark, path)) == 3 and seen(spark, path) == [("d", 2002), ("e", 2003)]


def test_of_two_writers_of_a_year_one_wins_and_other_years_stay(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    published.publish(years(spark, ("a", 2001)), path)
    other = lambda *rows: lambda: published.publish(years(spark, *rows), path)
    assert published.publish(years(spark, ("mine", 2002)), path, staged_hook=other(("theirs", 2003))) == 3
    assert seen(spark, path) == [("a", 2001), ("mine", 2002), ("theirs", 2003)]
    with pytest.raises(published.Conflict):
        published.publish(years(spark, ("late", 2001), ("late", 2005)), path, staged_hook=other(("early", 2001)))
    assert seen(spark, path) == [("early", 2001), ("mine", 2002), ("theirs", 2003)]


def test_a_taken_number_is_never_written_over(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    published.publish(years(spark, ("a", 2001)), path)
    published._write_text(spark, f"{path}/manifests/.late", "{}")
    assert not published._renamed(spark, f"{path}/manifests/.late", f"{path}/manifests/00000001.json")
    assert seen(spark, path) == [("a", 2001)]


def test_audits_stop_a_commit(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    with pytest.raises(published.Rejected, match="too few"):
        published.publish(years(spark, ("a", 2001)), path, audit=lambda df: "too few" if df.count() < 2 else None)
    with pytest.raises(published.Rejected):
        published.publish(years(spark, ("a", None)), path)  # a row without a year is in no year
    assert published.read(spark, path) is None
