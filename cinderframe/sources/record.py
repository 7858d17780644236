"""The record's tables, derived from a star schema's: fires, severity, tracks, points, ways, manifests.

Each derivation is one SQL text that Spark and other engines run unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed derivations; geometry is in whole metres, no vertex on a line of cell centres.
DERIVED: dict[str, str] = {
    "fx_fires": """
select substr('WAORCAIDNVUTAZMTWYCONMTXFLAK', cast(o_custkey % 14 as int)*2+1, 2)
         || lpad(cast(o_orderkey as string), 10, '0') as id,
       'FIRE ' || cast(o_orderkey as string) as name,
       case when o_orderpriority = '5-LOW' then 'Prescribed Fire' else 'Wildfire' end as type,
       cast(o_orderdate as date) as ig_date,
       case when o_orderkey % 41 = 0 then null else o_totalprice end as acres,
       case when o_orderstatus = 'F' then 'Initial' else 'Extended' end as asmnt,
       o_orderkey as k,
       60 * ((o_orderkey*7919) % 1500) as cx,
       60 * ((o_orderkey*104729 + o_custkey*31) % 1500) as cy,
       60 * (1 + o_orderkey % 8) as u,
       cast(o_orderkey % 5 as int) as shape
from orders""",
    "fx_tmpl": """
select * from (values
 (0,0,0,0,0,0,6,0),(0,0,0,1,6,0,6,4),(0,0,0,2,6,4,0,4),(0,0,0,3,0,4,0,0),
 (1,0,0,0,2,0,5,0),(1,0,0,1,5,0,6,3),(1,0,0,2,6,3,4,6),(1,0,0,3,4,6,1,5),(1,0,0,4,1,5,0,2),(1,0,0,5,0,2,2,0),
 (2,0,0,0,0,0,6,0),(2,0,0,1,6,0,6,6),(2,0,0,2,6,6,0,6),(2,0,0,3,0,6,0,0),
 (2,0,1,0,2,2,2,4),(2,0,1,1,2,4,4,4),(2,0,1,2,4,4,4,2),(2,0,1,3,4,2,2,2),
 (3,0,0,0,0,0,2,0),(3,0,0,1,2,0,2,2),(3,0,0,2,2,2,0,2),(3,0,0,3,0,2,0,0),
 (3,1,0,0,4,3,6,3),(3,1,0,1,6,3,6,6),(3,1,0,2,6,6,4,6),(3,1,0,3,4,6,4,3),
 (4,0,0,0,0,0,6,6),(4,0,0,1,6,6,6,0),(4,0,0,2,6,0,0,6),(4,0,0,3,0,6,0,0)
) t(shape, part, ring, seq, fx0, fy0, fx1, fy1)""",
    "fx_edges": """
select f.id, t.part, t.ring, t.seq, cx+fx0*u as x0, cy+fy0*u as y0, cx+fx1*u as x1, cy+fy1*u as y1
from fx_fires f join fx_tmpl t on f.shape = t.shape""",
    "fx_stats": """
select f.id, cast(case when f.k % 29 = 0 then 6 else 1 + (l_linenumber - 1) % 6 end as int) as class,
       cast(sum(cast(l_quantity as bigint)) as bigint) as px
from lineitem join fx_fires f on l_orderkey = f.k
where year(f.ig_date) <> 1998 and (year(f.ig_date) < 2000 or f.k % 3 = 0)
group by 1, 2""",
    "fx_mosaic": """
select y.year, r.o_orderkey as row, 4*b.o_orderkey as c0, 4*b.o_orderkey + 4 as c1,
       cast((cast(floor(r.o_orderkey/4) as bigint)*31 + b.o_orderkey*17 + y.year) % 7 as int) as class
from (values (1996),(1997),(1999),(2000)) y(year), orders r, orders b
where r.o_orderkey < 1000 and b.o_orderkey < 250
  and (y.year < 2000 or r.o_orderkey < 500)
  and (cast(floor(r.o_orderkey/4) as bigint)*31 + b.o_orderkey*17 + y.year) % 7 <> 0""",
    "fx_track_points": """
select user_id as track, cast(floor((n-1)/10) as int) as seg, cast((n-1) % 10 as int) as pt,
       90*((user_id*53) % 900) + 70*n + 10*(event_id % 7) as x,
       90*((user_id*101) % 900) + 50*n + 10*(event_id % 11) as y,
       -120 + (90*((user_id*53) % 900) + 70*n + 10*(event_id % 7))*0.00001e0 as lon,
       40 + (90*((user_id*101) % 900) + 50*n + 10*(event_id % 11))*0.00001e0 as lat
from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n
      from events) e""",
    "fx_points": """
select event_id as pt, 10*((event_id*48271) % 9000) + 5 as x, 10*((event_id*16807 + user_id) % 9000) + 5 as y
from events""",
    "fx_sections": """
select cast((n_nationkey*7) % 25 as int) as pos, n_nationkey as section,
       'PCT - ' || n_name || ' Section ' || cast(n_regionkey as string) as name
from nation""",
    "fx_way_points": """
select s.s_nationkey as section, s.s_suppkey as way, cast(o.o_orderkey as int) as pt,
       -120 + s.s_suppkey*0.01e0 + o.o_orderkey*0.0005e0 as lon,
       36 + s.s_nationkey*0.1e0 + ((o.o_orderkey*o.o_orderkey*7 + s.s_suppkey) % 13)*0.0001e0 as lat
from supplier s
join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19),(20),(21),(22),(23),(24),(25),(26),(27),(28),(29),(30),(31),(32),(33),(34),(35),(36),(37),(38),(39)) n(k) on n.k < (s.s_suppkey % 9)*5
join orders o on o.o_orderkey = n.k""",
    "fx_manifest": """
select cast(p_partkey as string) as key, cast(p_size as bigint) as size, md5(p_name) as etag,
       case when p_partkey % 17 = 0 then null
            when p_partkey % 13 = 0 then cast(p_size as bigint) + 1 else cast(p_size as bigint) end as remote_size,
       case when p_partkey % 17 = 0 then null
            when p_partkey % 11 = 0 then md5(p_type) || '-2'
            when p_partkey % 7 = 0 then md5(p_type) else md5(p_name) end as remote_etag
from part""",
}
#: What each derivation reads: other derivations, then driver tables.
NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "fx_fires": ((), ("orders",)),
    "fx_tmpl": ((), ()),
    "fx_edges": (("fx_fires", "fx_tmpl"), ()),
    "fx_stats": (("fx_fires",), ("lineitem",)),
    "fx_mosaic": ((), ("orders",)),
    "fx_track_points": ((), ("events",)),
    "fx_points": ((), ("events",)),
    "fx_sections": ((), ("nation",)),
    "fx_way_points": ((), ("supplier", "orders")),
    "fx_manifest": ((), ("part",)),
}


def with_derived(*names: str) -> str:
    """"with a as (...), b as (...)" of derivations and all they need, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS[n][0]:
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({DERIVED[n]})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table (fx_...) or a driver table of the folder."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = with_derived(name)
    todo, reads = [name], set()
    while todo:
        more, tables = NEEDS[todo.pop()]
        todo += more
        reads.update(tables)
    for t in reads:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{text} select * from {name}")
