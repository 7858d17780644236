"""Every registered query against its oracle at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from cinderframe.jobs import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(found):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in found)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = registry.queries()[name](spark, str(SF))
    want = con.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got.select(*names).collect()) == rows(want.select(*names).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_gives_rows(spark, name):
    assert registry.queries()[name](spark, str(SF)).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    last = __spark_entry__.entry(spark).orderBy("year").collect()[-1]
    assert last["fires_to"] == 911


def test_tables_of_two_threads_keep_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from cinderframe.sources.scratch import passing_tables, written

    both = Barrier(2, timeout=120)

    def work(n):
        with passing_tables(spark) as stays:
            passing = written(spark.range(n), "passing")
            both.wait()
            kept = stays(passing, "kept")
            if n == 2:
                both.wait()  # the other one's block has ended and deleted its own tables
                return kept.count() + passing.count()
        both.wait()
        return kept.count()

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(work, (2, 3))) == [3, 4]
