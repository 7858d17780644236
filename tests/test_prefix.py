"""Two-level windows against plain ones, with one line of a third of all rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cinderframe.operators import prefix, trail


def lines(spark):
    rng = random.Random(6)
    sizes = {"long": 4_000, "empty-ish": 1, "two": 2} | {f"s{i}": rng.randint(1, 400) for i in range(40)}
    rows = [(k, pt * 3 - 50, rng.uniform(-120, -119), rng.uniform(39, 40)) for k, n in sizes.items() for pt in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "line string, pt int, lon double, lat double"), rows


def test_sums_and_next_rows_equal_plain_windows_and_blocks_are_even(spark):
    table, rows = lines(spark)
    want = {}
    for name in {r[0] for r in rows}:
        own, along = sorted(r for r in rows if r[0] == name), 0
        for i, r in enumerate(own):
            want[r[:2]] = (own[i + 1][2] if i + 1 < len(own) else None, along)
            along += r[1] ** 2
    blocks = prefix.blocked(table, ["line"], "pt", 12)
    sizes = [r["count"] for r in blocks.groupBy(prefix.BLOCK).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    out = prefix.with_sum_before(prefix.with_next(blocks, ["line"], "pt", after="lon"), ["line"], "pt", F.col("pt") * F.col("pt") * F.lit(1.0), "along")
    assert {(r["line"], r["pt"]): (r["after"], r["along"]) for r in out.collect()} == want
    assert out.where("line = 'long'").select(prefix.BLOCK).distinct().count() > 3


def test_distances_along_lines_of_any_length(spark):
    table, _ = lines(spark)
    got = {(r["line"], r["pt"]): r["along"] for r in trail.distance_along(table, ["line"]).collect()}
    miles = {(r["line"], r["pt"]): r["miles"] for r in trail.segment_miles(table, ["line"]).collect()}
    assert len(got) == len(miles) == table.count()
    for name in ("long", "two", "s3"):
        along = 0.0
        for key in sorted(k for k in got if k[0] == name):
            assert abs(got[key] - along) < 1e-6
            along += miles[key] or 0.0
    assert trail.distance_along(table.limit(0), ["line"]).count() == 0
