"""Queries over fires, their severity, years, and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderframe.functions import scalar
from cinderframe.jobs import sinks
from cinderframe.jobs.common import FIRST, LAST, RECORD, TAGGED, _STATES, fx, register
from cinderframe.operators import fires as fi
from cinderframe.operators import geom, verify

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)
SUMMARY = "years as (select year, count(*) as fires, cast(round_even(sum(coalesce(acres, 0e0)), 0) as bigint) as acres, count(*) filter (sev_ok) as sev from tagged group by year)"


@query("src1_perimeters", f"{fx('fx_fires')} select id, name, type, ig_date, acres, asmnt from fx_fires")
def src1(t):
    return t("fx_fires").select("id", "name", "type", "ig_date", "acres", "asmnt")


@query("src3_mosaic_window", f"{fx('fx_mosaic')} select year, count(*) as runs, cast(sum(c1-c0) as bigint) as cells from fx_mosaic where row between 100 and 599 and c0 < 600 and c1 > 200 group by year")
def src3(t):
    m = t("fx_mosaic").where("row between 100 and 599 and c0 < 600 and c1 > 200")
    return m.groupBy("year").agg(F.count("*").alias("runs"), F.sum(F.col("c1") - F.col("c0")).alias("cells"))


@query("src4_severity_map", f"{fx('fx_stats')} select id, class, px from fx_stats")
def src4(t):
    """Stats as the JSON map they travel in, read back to rows."""
    maps = t("fx_stats").groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("string"), "px")))).alias("value"))
    return maps.select("id", F.explode(F.from_json("value", "map<string,bigint>")).alias("class", "px")).select("id", F.col("class").cast("int").alias("class"), "px")


@query("flt1_western_states", f"{fx('fx_fires')} select id, substr(id, 1, 2) as state from fx_fires where substr(id, 1, 2) in ({_STATES})")
def flt1(t):
    return fi.western(t("fx_fires")).select("id", scalar.state(F.col("id")).alias("state"))


@query("flt2_date_range", f"{fx('fx_fires')} select id, ig_date from fx_fires where ig_date between date '{FIRST}' and date '{LAST}'")
def flt2(t):
    return fi.dated(t("fx_fires"), FIRST, LAST).select("id", "ig_date")


@query("flt3_renamed_fields", f"{fx('fx_fires')} select id as event_id, name as incid_name, type as incid_type, acres as burnbndac from fx_fires")
def flt3(t):
    names = {"id": "event_id", "name": "incid_name", "type": "incid_type", "acres": "burnbndac"}
    return t("fx_fires").select(*[F.col(a).alias(b) for a, b in names.items()])


@query("flt4_fire_year", f"{fx('fx_fires')}, {RECORD} select id, year from rec")
def flt4(t):
    return t.record().select("id", "year")


@query("flt5_drawable_classes", f"{fx('fx_stats')} select id, class, px from fx_stats where class between 1 and 5")
def flt5(t):
    return fi.drawable(t("fx_stats"))


@query("flt8_season_and_to_date", f"{fx('fx_fires')}, {RECORD} select 'season' as scope, id from rec where year = 1999 union all select 'to date', id from rec where year <= 1999")
def flt8(t):
    rec = t.record()
    parts = (("season", fi.season(rec, 1999)), ("to date", fi.up_to(rec, 1999)))
    one, two = (d.select(F.lit(n).alias("scope"), "id") for n, d in parts)
    return one.unionByName(two)


@query("flt9_usable_lines", f"{fx('fx_way_points')} select section, way, cast(count(*) as int) as n from fx_way_points group by 1, 2 having count(*) > 1")
def flt9(t):
    """Ways of two points or more; ways without geometry and sections without ways drop out."""
    node = F.struct("pt", F.struct("lat", "lon").alias("p"))
    shapes = t("fx_way_points").groupBy("way").agg(F.collect_list(node).alias("geometry"))
    ways = t("supplier").select(F.col("s_suppkey").alias("way"), F.col("s_nationkey").alias("section")).join(shapes, "way", "left")
    lines = ways.where(F.size(F.coalesce("geometry", F.array())) > 1)
    return t("fx_sections").select("section").join(lines, "section").select("section", "way", F.size("geometry").alias("n"))


@query("flt10_severity_status", f"""{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED}, ok as (select year, count(*) filter (sev_ok) as n_ok from tagged group by year)
select id, t.year, sev_ok, case when sev_ok then 'mapped' when t.year = (select max(year) from rec) then 'not yet mapped' when n_ok = 0 then 'not available' else 'unmapped' end as status
from tagged t join ok on ok.year = t.year""")
def flt10(t):
    return fi.severity_status(t.tagged())


@query("flt11_unknown_acres", f"{fx('fx_fires')}, {RECORD} select year, count(*) as fires, count(*) - count(acres) as unknown, round(sum(coalesce(acres, 0e0)), 2) as acres from rec group by year")
def flt11(t):
    unknown = F.count_if(F.col("acres").isNull()).alias("unknown")
    return t.record().groupBy("year").agg(F.count("*").alias("fires"), unknown, F.round(F.sum(F.coalesce(F.col("acres").cast("double"), F.lit(0.0))), 2).alias("acres"))


@query("flt12_viewport", f"""{fx('fx_edges', 'fx_stats')}, {RECORD}, {TAGGED},
box as (select id, min(least(x0,x1)) as xmin, min(least(y0,y1)) as ymin, max(greatest(x0,x1)) as xmax, max(greatest(y0,y1)) as ymax from fx_edges group by id)
select id, year from tagged join box using (id) where xmax >= 20000 and xmin <= 60000 and ymax >= 20000 and ymin <= 60000 and year between 1997 and 1999
and round_even(1e2*c3/m, 0) + round_even(1e2*c4/m, 0) > 0""")
def flt12(t):
    """Fires in a box and a range of years with moderate or high severity."""
    seen = t.tagged().where((F.element_at("sev", 3) + F.element_at("sev", 4) > 0) & F.col("year").between(1997, 1999))
    box = geom.envelopes(t("fx_edges")).where("xmax >= 20000 and xmin <= 60000 and ymax >= 20000 and ymin <= 60000")
    return seen.join(box, "id").select("id", "year")


@query("jn1_fires_with_stats", f"{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED} select id, year, sev_ok from tagged")
def jn1(t):
    return t.tagged().select("id", "year", "sev_ok")


@query("agg3_class_percents", f"{fx('fx_stats')}, {RECORD}, {TAGGED} select id, " + ", ".join(f"cast(round_even(1e2*c{c}/m, 0) as int) as p{c}" for c in fi.CLASSES) + " from mapped")
def agg3(t):
    return fi.class_percents(t("fx_stats")).select("id", *[F.element_at("sev", c).alias(f"p{c}") for c in fi.CLASSES])


@query("agg1_year_summary", f"{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED}, {SUMMARY} select * from years")
def agg1(t):
    return t.summary()


@query("win2_accumulated_totals", f"{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED}, {SUMMARY} select year, fires, acres, sev, cast(sum(fires) over (order by year) as bigint) as fires_to, cast(sum(acres) over (order by year) as bigint) as acres_to from years")
def win2(t):
    return fi.accumulated(t.summary())


@query("snk3_summary_arrays", f"{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED}, {SUMMARY} select string_agg(cast(year as varchar), ',' order by year) as years, string_agg(cast(fires as varchar), ',' order by year) as fires, string_agg(cast(acres as varchar), ',' order by year) as acres, string_agg(cast(sev as varchar), ',' order by year) as sev from years")
def snk3(t):
    """Year rows folded to parallel arrays in order of year."""
    rows = t.summary().agg(F.sort_array(F.collect_list(F.struct("year", "fires", "acres", "sev"))).alias("s"))
    return rows.select(*[F.array_join(F.col(f"s.{n}").cast("array<string>"), ",").alias(o) for n, o in (("year", "years"), ("fires", "fires"), ("acres", "acres"), ("sev", "sev"))])


@query("agg8_fires_by_state", f"{fx('fx_fires')}, {RECORD} select substr(id, 1, 2) as state, count(*) as fires from rec group by 1")
def agg8(t):
    return fi.fires_by_state(t.record())


@query("agg9_coverage_by_period", f"{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED} select case when year <= 1999 then 'to 1999' else 'after 1999' end as period, count(*) as fires, count(*) filter (sev_ok) as sev from tagged group by rollup(1)")
def agg9(t):
    return fi.coverage_by_period(t.tagged(), 1999)


@query("win4_largest_fire", f"{fx('fx_fires')}, {RECORD} select year, id, coalesce(acres, 0e0) as acres from rec qualify row_number() over (partition by year order by coalesce(acres, 0e0) desc, id) = 1")
def win4(t):
    return fi.largest_of_each_year(t.record())


@query("srt3_asmnt_by_frequency", f"{fx('fx_fires')}, {RECORD} select row_number() over (order by count(*) desc, state) as place, state, count(*) as fires from (select substr(id, 1, 2) as state from rec) group by state")
def srt3(t):
    from pyspark.sql import Window as W

    by = fi.fires_by_state(t.record())
    return by.select(F.row_number().over(W.orderBy(F.desc("fires"), "state")).cast("long").alias("place"), "state", "fires")


@query("jn7_reconciled_ids", f"""{fx('fx_fires', 'fx_stats')}, {RECORD}, src as (select distinct year, id from rec),
built as (select distinct cast(year(f.ig_date) as int) as year, s.id from fx_stats s join fx_fires f on s.id = f.id)
select coalesce(s.year, b.year) as year, coalesce(s.id, b.id) as id, case when b.id is null then 'missing' else 'extra' end as state
from src s full outer join built b on s.year = b.year and s.id = b.id where s.id is null or b.id is null""")
def jn7(t):
    """Record fires against fires with stats, both ways."""
    built = fi.with_year(t("fx_fires")).join(t("fx_stats").select("id").distinct(), "id")
    return verify.reconciled(t.record(), built, ["year", "id"])


@query("jn8_expected_severity", f"{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED}, {SUMMARY} select year, fires, sev, case when sev > 0 then 'OK' when year = 1998 then 'WARN' else 'FAIL' end as state from years")
def jn8(t):
    return fi.expected_severity(t.summary(), (1998,))


@query("jn9_missing_mosaics", f"""{fx('fx_mosaic')}, held as (select distinct year from fx_mosaic), landed as (select p_partkey % 41 as year, min(p_size) as n from part group by 1)
select y.year, case when l.year is null then 'no url' when n % 5 = 1 then 'http 404' when n * 50000 < 100000 then 'archive too small' when n % 3 = 0 then 'no raster inside' end as reason
from (select cast(unnest(range(1980, 2021)) as int) as year) y left join landed l on l.year + 1980 = y.year where y.year not in (select year from held)""")
def jn9(t):
    """Years without a mosaic and what their landed archive says."""
    missing = fi.missing_years(1980, 2020, t("fx_mosaic"))
    landed = t("part").groupBy((F.col("p_partkey") % 41 + 1980).cast("int").alias("year")).agg(F.min("p_size").alias("n"))
    rows = missing.join(F.broadcast(landed.withColumn("url", F.lit("u"))), "year", "left")  # a row a year
    code = F.when(F.col("n") % 5 == 1, 404).otherwise(200)
    return rows.select("year", fi.landing_problem(F.col("url"), code, F.col("n") * 50000, F.when(F.col("n") % 3 == 0, 0).otherwise(1)).alias("reason"))


@query("jn12_age_expansion", f"""{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED}, {SUMMARY} select f.year as frame, y.year, y.fires, round(case f.year - y.year when 0 then 0.95e0 when 1 then 0.85e0 when 2 then 0.8e0 when 3 then 0.75e0 when 4 then 0.732e0 end, 6) as opacity
from years y join years f on y.year <= f.year""")
def jn12(t):
    return fi.age_expansion(t.summary())


@query("jn10_object_manifest", f"""{fx('fx_manifest')}, l as (select key, size, etag from fx_manifest where cast(key as bigint) % 19 <> 0), r as (select key, remote_size, remote_etag from fx_manifest where remote_size is not null)
select coalesce(l.key, r.key) as key, case when r.key is null then 'missing' when l.key is null then 'extra' when size <> remote_size then 'size differs' when remote_etag like '%-%' then 'size only'
when etag <> remote_etag then 'content differs' else 'same' end as state from l full outer join r on l.key = r.key""")
def jn10(t):
    """A local listing against a remote one, both ways."""
    m = t("fx_manifest")
    local = m.where(F.col("key").cast("long") % 19 != 0).select("key", "size", "etag")
    return verify.listings(local, m.where("remote_size is not null").select("key", F.col("remote_size").alias("size"), F.col("remote_etag").alias("etag")))


@query("snk7_merged_stats", f"""{fx('fx_stats')}, new as (select id, class, px * 2 as px from fx_stats where substr(id, 12, 1) in ('0', '5'))
select id, class, px, 'new' as origin from new union all select id, class, px, 'old' from fx_stats where id not in (select id from new)""")
def snk7(t):
    """A year's stats merged into the cumulative ones: the new win per fire."""
    old = t("fx_stats")
    new = old.where(F.substring("id", 12, 1).isin("0", "5")).withColumn("px", F.col("px") * 2)
    return sinks.merged(old.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")))


@query("set1_merged_years", f"{fx('fx_fires')}, {RECORD} select year, count(*) as fires, count(distinct id) as ids from rec group by year")
def set1(t):
    """Year sets merged by name, none lost or doubled."""
    rec, merged = t.record(), None
    for y in range(1996, 2001):
        part = fi.season(rec, y)
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy("year").agg(F.count("*").alias("fires"), F.countDistinct("id").alias("ids"))


@query("set2_years_lost", f"{fx('fx_fires', 'fx_stats')}, {RECORD}, {TAGGED} select distinct year from rec except select distinct year from tagged where sev_ok")
def set2(t):
    tagged = t.tagged()
    return tagged.select("year").distinct().exceptAll(tagged.where("sev_ok").select("year").distinct())


@query("fn6_rounding_rules", f"{fx('fx_stats')} select id, class, cast(round_even(px / 2e0, 0) as bigint) as even, cast(round(px / 2e0) as bigint) as away, round(px * 8100 / 4046.86e0, 2) as acres from fx_stats")
def fn6(t):
    half = F.col("px") / F.lit(2.0)
    return t("fx_stats").select("id", "class", scalar.whole_half_even(half).alias("even"), F.round(half).cast("long").alias("away"), F.round(scalar.acres(F.col("px") * 8100), 2).alias("acres"))
