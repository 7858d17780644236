"""Registration of queries and the record's usual cut of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderframe.functions.scalar import WEST
from cinderframe.operators import fires as fi
from cinderframe.sources.record import table, with_derived

FIRST, LAST = "1996-01-01", "2000-12-31"
_STATES = ", ".join(f"'{s}'" for s in WEST)
#: The record: western fires of its years, with their year.
RECORD = f"rec as (select *, cast(year(ig_date) as int) as year from fx_fires where substr(id, 1, 2) in ({_STATES}) and ig_date between date '{FIRST}' and date '{LAST}')"
REC_EDGES = "rec_edges as (select e.* from fx_edges e join rec using (id))"
#: Cells by counting crossings at every cell centre: not how the operators work.
REC_CELLS = """boxes as (select id, cast(floor(min(least(x0,x1))/90) as bigint) as c_lo, cast(ceil(max(greatest(x0,x1))/90) as bigint)+1 as c_hi,
  cast(floor(min(least(y0,y1))/90) as bigint) as r_lo, cast(ceil(max(greatest(y0,y1))/90) as bigint)+1 as r_hi from rec_edges group by id),
grid as (select id, row, unnest(range(c_lo, c_hi)) as col from (select id, c_lo, c_hi, unnest(range(r_lo, r_hi)) as row from boxes)),
cells as (select g.id, g.row, g.col from grid g join rec_edges e on e.id = g.id
  and least(e.y0,e.y1) <= 45+90*g.row and 45+90*g.row < greatest(e.y0,e.y1)
  and e.x0 + (45e0+90*g.row-e.y0)*(e.x1-e.x0)/(e.y1-e.y0) <= 45+90*g.col
  group by 1, 2, 3 having count(*) % 2 = 1)"""
TAGGED = """mapped as (select id, sum(px) as m, sum(case when class=1 then px else 0 end) as c1, sum(case when class=2 then px else 0 end) as c2,
  sum(case when class=3 then px else 0 end) as c3, sum(case when class=4 then px else 0 end) as c4, sum(case when class=5 then px else 0 end) as c5
  from fx_stats where class between 1 and 5 group by id),
tagged as (select r.*, m.m, c1, c2, c3, c4, c5, m.id is not null as sev_ok from rec r left join mapped m on r.id = m.id)"""


def fx(*names: str) -> str:
    return with_derived(*names)


def register(queries: dict, oracles: dict) -> Callable:
    """A decorator: query(name, sql) registers a function of a Tables."""
    def query(name: str, sql: str | None = None) -> Callable:
        def add(f: Callable[[Tables], DataFrame]) -> Callable:
            queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                oracles[name] = sql
            return f

        return add

    return query


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def record(self) -> DataFrame:
        return fi.with_year(fi.dated(fi.western(self("fx_fires")), FIRST, LAST))

    def tagged(self) -> DataFrame:
        return fi.tag_severity(self.record(), self("fx_stats"))

    def summary(self) -> DataFrame:
        return fi.year_summary(self.tagged())

    def edges(self) -> DataFrame:
        return self("fx_edges").join(self.record().select("id"), "id", "left_semi")

    def runs(self) -> DataFrame:
        from cinderframe.operators.raster import rasterise

        return rasterise(self.edges())

    def lonlat_boxes(self) -> DataFrame:
        """The record's boxes in degrees, by the scale of the derived tracks."""
        from cinderframe.operators.geom import envelopes

        def deg(c: str, base: int):
            return (F.lit(float(base)) + F.col(c) * F.lit(0.00001)).alias({"xmin": "lon0", "xmax": "lon1", "ymin": "lat0", "ymax": "lat1"}[c])

        return envelopes(self.edges()).select("id", deg("xmin", -120), deg("ymin", 40), deg("xmax", -120), deg("ymax", 40))
