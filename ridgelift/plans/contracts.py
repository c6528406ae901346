"""Contracts: whole rosters of members, extensions over the shared frame, windows of local days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.functions import times, wire
from ridgelift.operators import analysis, archive, findings, members
from ridgelift.sources import file_names
from ridgelift.sources.projections import HISTORY, MEMBERS, member_value, station_history, table

from .compare import _sited
from .findings import PROFILE, R1, ZONE, profile_hours
from .registry import Registry

R = Registry()
ROSTER = tuple(range(16))


@R.add(
    "r12_r13_rosters",
    f"""with {MEMBERS}, s as (select hour_id % 5 as field, hour_id // 5 as site_id, member, case when hour_id % 7 = 3 and member = 4 then 2 else 1 end as grid_key, case when (hour_id % 11) <= 8 then coalesce(v, 0) end as value from m where member < 16 and not (hour_id % 13 = 5 and member in (3, 9))),
g as (select field, site_id, count(*) as n, count(value) as n_values, count(distinct grid_key) as grids, sum(value) filter (member = 15) as last_value, sum(value) as total from s group by all), a as (select * from (select distinct hour_id % 5 as field from m) f cross join (select distinct hour_id // 5 as site_id from m) t)
select field::bigint as field, site_id::bigint as site_id, case when n is null then 'nothing there' when n < 16 then 'members missing: 3,9' when n_values < 16 then 'values missing' when grids <> 1 then 'several grids' end as problem, case when n = 16 and n_values = 16 and grids = 1 then round(last_value, 6) end as last_value, case when n = 16 and n_values = 16 and grids = 1 then round(total, 4) end as total from a left join g using (field, site_id)""",
)
def r12_r13_rosters(spark, d):
    k = F.col("hour_id")
    m = member_value(spark, d).where((F.col("member") < 16) & ~((k % 13 == 5) & F.col("member").isin(3, 9)))
    value = members.gated(F.coalesce("v", F.lit(0.0)), k % 11, 8)
    samples = m.select((k % 5).alias("field"), F.floor(k / 5).alias("site_id"), "member", F.when((k % 7 == 3) & (F.col("member") == 4), 2).otherwise(1).alias("grid_key"), F.lit(False).alias("along_grid"), value.alias("value"))
    r = members.rosters(samples, samples, samples, ROSTER)
    return r.select("field", "site_id", "problem", F.round(F.get("values", F.lit(15)), 6).alias("last_value"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@R.add(
    "f16_extensions",
    f"""with {PROFILE}, g as (select profile_id, count(*) filter (gust > 15) as n from hp group by profile_id), t as (select profile_id, max(lift_top - launch_m) as d from hp group by profile_id), qy as (select distinct profile_id, day from hp where not exists (select 1 from wh where wh.profile_id = hp.profile_id and wh.day = hp.day)), qn as (select profile_id, count(*) as n from qy group by all)
select profile_id, 'club/gustyHours' as name, n::double as value from g union all select profile_id, 'club/depth', {R1.format('d')} from t union all select profile_id, 'school/quietDays', n::double from qn""",
)
def f16_extensions(spark, d):
    gusty = analysis.Extension("club/gustyHours", lambda h, _: h.groupBy("profile_id").agg(F.count_if(F.col("wind_gust_mps") > 15).cast("double").alias("value")))
    depth = analysis.Extension("club/depth", lambda h, _: h.groupBy("profile_id").agg((F.floor(F.max(F.col("usable_lift_top_m") - F.col("launch_m")) * 10 + 0.5) / 10).alias("value")))
    quiet = analysis.Extension("school/quietDays", lambda _, f: f.where("kind = 'quietDay'").groupBy("profile_id").agg(F.count("*").cast("double").alias("value")))
    a = analysis.analyse(profile_hours(spark, d).drop("levels"), {"thermalWindow": findings.thermal_windows, "quietDay": findings.quiet_days}, [gusty, depth, quiet])
    return a.extensions.select("profile_id", "name", F.get_json_object("statement", "$.value").cast("double").alias("value"))


@R.add(
    "d08_r32_local_days",
    f"""with {HISTORY}, n as (select station_id, strftime(max(observed_at) at time zone 'UTC' at time zone '{ZONE}' - interval 5 day, '%Y-%m-%d') as day from h group by all), w as (select station_id, day, strftime(day::date - 1, '%Y-%m-%d') as day_before, day::timestamp at time zone '{ZONE}' at time zone 'UTC' as from_at from n)
select w.station_id, day, day_before, from_at, count(h.seq) as points, round(max(wind_avg_mps), 6) as peak_mps from w left join h on h.station_id = w.station_id and observed_at >= from_at and observed_at < from_at + interval 24 hour group by all""",
)
def d08_r32_local_days(spark, d):
    h = station_history(spark, d).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    newest = h.groupBy("station_id").agg(archive.day_step(times.local_day(F.max("observed_at"), ZONE), -5).alias("day"))
    start, _ = archive.day_window(F.col("day"), ZONE)
    inside = archive.in_local_day(h.join(newest, "station_id"), F.col("day"), ZONE).groupBy("station_id").agg(F.count("*").alias("points"), F.max("wind_avg_mps").alias("peak"))
    out = newest.join(inside, "station_id", "left")
    return out.select("station_id", "day", archive.day_step(F.col("day"), -1).alias("day_before"), start.cast("timestamp_ntz").alias("from_at"), F.coalesce("points", F.lit(0)).alias("points"), F.round("peak", 6).alias("peak_mps"))




def compared(spark, d):
    """Votes and board from one evaluation: what `analyse_then_compare` gives for the pooled members."""
    return analysis.analyse_then_compare(profile_hours(spark, d).drop("levels"), _sited, ZONE)


@R.add(
    "d17_weak_tags",
    """with t as (select o_orderkey as k, '{"key":' || o_orderkey::varchar || ',"note":"' || o_orderpriority || ' é ' || (o_orderkey % 7)::varchar || '"}' as j from orders), c as (select k, list_transform(string_split(j, ''), lambda x: unicode(x)::bigint) as u from t)
select k, 'W/"' || lower(lpad(to_hex(list_reduce([2166136261::bigint] || u, lambda h, x: (xor(h, x) * 16777619) % 4294967296)), 8, '0')) || lower(lpad(to_hex(list_reduce([19088743::bigint] || u, lambda h, x: (xor(h, x) * 16777619) % 4294967296)), 8, '0')) || '"' as tag from c""",
)
def d17_weak_tags(spark, d):
    k = F.col("o_orderkey")
    j = F.concat(F.lit('{"key":'), k.cast("string"), F.lit(',"note":"'), F.col("o_orderpriority"), F.lit(" é "), (k % 7).cast("string"), F.lit('"}'))
    return table(spark, d, "orders").select(k.alias("k"), wire.weak_tag(j).alias("tag"))


@R.add(
    "r03_r14_r16_schedules",
    """with t as (select o_orderkey as k, o_orderkey % 241 as h, o_orderkey % 3 as m from orders) select k, h <= 168 or h % 6 = 0 as dense, case when h <= 168 or h % 6 = 0 then 9 else 4 end as levels, case m when 0 then 'instantRate' else 'windowMeanRate' end as precipitation, case when k % 2 = 0 then 'hourMax' end as gust, k % 5 <> 0 as deterministic, k % 10 = 5 as dropout from t""",
)
def r03_r14_r16_schedules(spark, d):
    k = F.col("o_orderkey")
    hour, name = k % 241, lambda on: F.when(on, "VAR")
    said = wire.semantics(name(k % 3 == 1), name(k % 3 == 2), name(k % 2 == 0))
    run = F.when(k % 5 == 0, F.when(k % 10 == 5, 0).otherwise(21))
    levels = wire.scheduled_levels(hour, (1000, 950, 925, 900, 850, 800, 700, 600, 500))
    return table(spark, d, "orders").select(k.alias("k"), wire.dense_hour(hour).alias("dense"), F.size(levels).alias("levels"), said["precipitation"].alias("precipitation"), said["gust"].alias("gust"), wire.is_deterministic(run).alias("deterministic"), wire.is_dropout(F.struct(run.alias("members"))).alias("dropout"))


@R.add(
    "d11_file_names",
    """with t as (select o_orderkey as k, o_orderdate::timestamp + (o_orderkey % 4 * 6)::int * interval 1 hour as r, o_orderkey % 121 as h, o_orderkey % 3 as m from orders),
n as (select *, case m when 0 then strftime(r, '%Y%m%dT%HZ_MSC_GDPS_AirTemp_AGL-2m_LatLon0.15_PT') || lpad(h::varchar, 3, '0') || 'H.grib2' when 1 then strftime(r, 'hrrr.%Y%m%d/conus/hrrr.t%Hz.wrfprsf') || case when h < 10 then '0' || h::varchar else h::varchar end || '.grib2' else strftime(r, 'rrfs.%Y%m%d/%H/rrfs.t%Hz.prslev.3km.f') || lpad(h::varchar, 3, '0') || '.conus.grib2' end as name from t)
select k, name, r as reference_time, h::int as hour, case m when 0 then 'AirTemp_AGL-2m' when 2 then 'prslev' end as variable from n""",
)
def d11_file_names(spark, d):
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 4 * 6 * 3600)
    hour = k % 121
    names = (
        F.when(k % 3 == 0, file_names.file_name("grid", at, hour, prefix=F.lit("MSC_GDPS"), variable=F.lit("AirTemp_AGL-2m"), grid=F.lit("LatLon0.15")))
        .when(k % 3 == 1, file_names.file_name("hrrr", at, hour))
        .otherwise(file_names.file_name("rrfs", at, hour, variable=F.lit("prslev")))
    )
    t = table(spark, d, "orders").select(k.alias("k"), names.alias("name"))
    read = [file_names.read_name(x, F.col("name")) for x in ("grid", "hrrr", "rrfs")]
    said = lambda f: F.coalesce(*[r[f] for r in read])
    return t.select("k", "name", said("reference_time").cast("timestamp_ntz").alias("reference_time"), said("hour").alias("hour"), F.coalesce(read[0]["variable"], read[2]["variable"]).alias("variable"))
