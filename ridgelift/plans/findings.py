"""Findings over profiles: sites are pooled into 250 profiles of hours in time order."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ridgelift.functions import times
from ridgelift.operators import findings

from .forecast import DERIVED, derived_hours
from .registry import Registry

R = Registry()
ZONE = "America/Vancouver"
PROFILES = 250


REFERENCE = "1995-01-01 00:00:00"


def _surface(k):
    """What the ground sees of an hour; every so many hours lack one of the measures."""
    speed = (k * 7 % 150).cast("double") / 10.0
    return (
        speed.alias("wind_speed_mps"),
        F.when(k % 11 != 0, (k * 53 % 360).cast("double")).alias("wind_direction_deg"),
        F.when(k % 13 != 0, speed * 1.5 + 1).alias("wind_gust_mps"),
        F.when(k % 17 != 0, F.when(k % 5 == 0, (k * 3 % 40).cast("double") / 10.0).otherwise(0.0)).alias("precipitation_mm_hr"),
        F.when(k % 19 != 0, (k * 19 % 101).cast("double")).alias("cloud_cover_pct"),
    )


def profile_hours(spark, d, ready=None):
    """ready: what to derive from an hour alone before hours are put in order, so that levels that only it needs are not sent along."""
    at = (F.col("valid_at").cast("timestamp") + F.make_interval(hours=(F.col("hour_id") % 24).cast("int"))).alias("valid_at")
    h = derived_hours(spark, d).select((F.col("site_id") % PROFILES).alias("profile_id"), "hour_id", at, (200.0 + F.col("site_id") % PROFILES * 13 % 1200).alias("launch_m"), "levels", "cloud_base_m", "boundary_layer_top_m", "thermal_velocity_mps", "usable_lift_top_m", (F.col("hour_id") * 7 % 400).cast("double").alias("cape_jkg"), (-(F.col("hour_id") * 13 % 60)).cast("double").alias("cin_jkg"), (200.0 + F.col("site_id") % PROFILES * 7 % 900).alias("profile_elevation_m"), *_surface(F.col("hour_id")), F.lit(REFERENCE).cast("timestamp").alias("reference_time"), "sensible_heat_flux_wm2")
    h = h.withColumn("day", times.local_day(F.col("valid_at"), ZONE)).withColumn("local_hour", times.local_hour(F.col("valid_at"), ZONE))
    return findings.prepared(h if ready is None else ready(h))


def shared_hours(spark, d, levels: bool = False, only: tuple[str, ...] = ()):
    """The hours of profiles for a query that reads them several times: evaluated once, kept by the executors (in memory, else on their disks), and made again where one is lost.
    Columns that are not among `only` are neither kept nor sent."""
    h = profile_hours(spark, d)
    if only:
        return h.select(*only).persist(StorageLevel.MEMORY_AND_DISK)
    return (h if levels else h.drop("levels")).persist(StorageLevel.MEMORY_AND_DISK)


def at_utc(df, *names):
    """Instants as zone-free timestamps, as SQL gives them."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df


PROFILE = f"""{DERIVED}, ph as (select site_id % {PROFILES} as profile_id, hour_id, valid_at + (hour_id % 24)::int * interval 1 hour as valid_at, (200.0 + (site_id % {PROFILES} * 13) % 1200)::double as launch_m, base as cloud_base_m, bl_top, w, lift_top,
  ((hour_id * 7) % 400)::double as cape, (-((hour_id * 13) % 60))::double as cin, (200.0 + (site_id % {PROFILES} * 7) % 900)::double as profile_elevation_m,
  ((hour_id * 7) % 150)::double / 10.0::double as sw, case when hour_id % 11 <> 0 then ((hour_id * 53) % 360)::double end as sd, case when hour_id % 13 <> 0 then ((hour_id * 7) % 150)::double / 10.0::double * 1.5::double + 1 end as gust,
  case when hour_id % 17 <> 0 then case when hour_id % 5 = 0 then ((hour_id * 3) % 40)::double / 10.0::double else 0.0::double end end as rain, case when hour_id % 19 <> 0 then ((hour_id * 19) % 101)::double end as cloud, sensible_heat_flux_wm2 as flux from f),
pi_ as (select *, row_number() over o - 1 as i, lag(valid_at) over o as pv, lead(valid_at) over o as nv, strftime(valid_at at time zone 'UTC' at time zone '{ZONE}', '%Y-%m-%d') as day, hour(valid_at at time zone 'UTC' at time zone '{ZONE}') as local_hour from ph window o as (partition by profile_id order by valid_at, hour_id)),
pg as (select *, greatest(1.0, floor((epoch_us(nv) - epoch_us(valid_at)) / 3.6e9 + 0.5)) as ga, greatest(1.0, floor((epoch_us(valid_at) - epoch_us(pv)) / 3.6e9 + 0.5)) as gb from pi_),
hp as (select *, case when nv is not null then ga when pv is not null then gb else 1.0 end as after_h, case when pv is not null then gb when nv is not null then ga else 1.0 end as before_h from pg),
ok as (select * from hp where w >= 0.9 and lift_top - launch_m >= 300),
wn as (select *, case when i = lag(i) over (partition by profile_id order by i) + 1 then 0 else 1 end as brk from ok),
wh as (select *, sum(brk) over (partition by profile_id order by i rows unbounded preceding) - 1 as window_id from wn)"""
R1 = "floor(({}) * 10 + 0.5) / 10"
R2 = "floor(({}) * 100 + 0.5) / 100"


@R.add("w01_hour_steps", f"with {PROFILE} select profile_id, hour_id, i as hour_index, before_h, after_h, day, local_hour::int as local_hour from hp")
def w01_hour_steps(spark, d):
    return profile_hours(spark, d).select("profile_id", "hour_id", F.col("hour_index").cast("long").alias("hour_index"), "before_h", "after_h", "day", "local_hour")


@R.add(
    "f01_thermal_window",
    f"""with {PROFILE}, z as (select profile_id, max(i) as last_i from hp group by 1) select profile_id, window_id::bigint as window_id, arg_min(day, i) as day, min(valid_at) as start_at, max(valid_at) as end_at, count(*) as n_hours, sum(after_h) as duration_h, max(after_h) as step_h,
 {R1.format('max(lift_top)')} as peak_lift_top_m, arg_min(valid_at, (-lift_top, i)) as peak_at, {R2.format('max(w)')} as peak_wstar_mps, min(i) = 0 as clipped_start, max(i) = any_value(last_i) as clipped_end from wh join z using (profile_id) group by profile_id, window_id""",
)
def f01_thermal_window(spark, d):
    return at_utc(findings.thermal_windows(profile_hours(spark, d)).drop("peak_above_launch_m"), "start_at", "end_at", "peak_at")


@R.add(
    "f03_quiet_day",
    f"""with {PROFILE}, qd as (select * from hp where not exists (select 1 from wh where wh.profile_id = hp.profile_id and wh.day = hp.day)),
g as (select profile_id, day, max(w) as mw, arg_min(valid_at, (-w, i)) filter (w is not null) as peak_wstar_at, max(lift_top - launch_m) as md, arg_min(valid_at, (-(lift_top - launch_m), i)) filter (lift_top is not null) as peak_depth_at, sum(after_h) as covered_h,
 arg_min(local_hour < before_h, i) and arg_max(local_hour >= 24 - after_h, i) as whole from qd group by profile_id, day)
select profile_id, day, {R2.format('mw')} as peak_wstar_mps, peak_wstar_at, {R1.format('md')} as peak_depth_m, peak_depth_at, covered_h, not whole as truncated,
 case when coalesce(mw < 0.9, true) and coalesce(md < 300, true) then 'wstar,depth' when coalesce(mw < 0.9, true) then 'wstar' when coalesce(md < 300, true) then 'depth' else 'coincidence' end as failed from g""",
)
def f03_quiet_day(spark, d):
    return at_utc(findings.quiet_days(profile_hours(spark, d)), "peak_wstar_at", "peak_depth_at")


@R.add(
    "f04_lift_ceiling",
    f"""with {PROFILE}, cs as (select *, case when cloud_base_m <= lift_top + 50 then 'cloudCapped' else 'sinkLimited' end as cause from wh), ec as (select *, case when cause <> lag(cause) over (partition by profile_id, window_id order by i) then 1 else 0 end as ch from cs),
sg as (select *, sum(ch) over (partition by profile_id, window_id order by i rows unbounded preceding) as segment_id from ec)
select profile_id, window_id::bigint as window_id, segment_id::bigint as segment_id, cause, min(valid_at) as start_at, max(valid_at) as end_at, count(*) as n_hours, {R1.format('max(lift_top)')} as peak_top_m, arg_min(valid_at, (-lift_top, i)) as peak_at, {R1.format('arg_min(cloud_base_m, (-lift_top, i))')} as cloud_base_m from sg group by profile_id, window_id, segment_id, cause""",
)
def f04_lift_ceiling(spark, d):
    return at_utc(findings.lift_ceilings(profile_hours(spark, d)), "start_at", "end_at", "peak_at")


@R.add(
    "f05_cap_timing",
    f"""with {PROFILE}, c as (select *, lag(valid_at) over w2 as before_at, floor((epoch_us(valid_at) - epoch_us(lag(valid_at) over w2)) / 3.6e9 + 0.5) as gap from hp window w2 as (partition by profile_id, day order by i)),
g as (select profile_id, day, count(*) as n, coalesce(bool_and(gap = 1), true) as hourly, max(gap) as step_h, max(cape) as mc, arg_min(valid_at, (-cape, i)) as mc_at, arg_min(valid_at, i) filter (abs(cin) < 25 and cape > 200) as b_at, arg_min((valid_at, before_at), i) filter (abs(cin) < 25 and cape > 200) as bb, arg_min(cape, i) filter (abs(cin) < 25 and cape > 200) as b_cape, bool_and(abs(cin) < 25) as never from c group by profile_id, day having count(*) >= 2)
select profile_id, day, case when mc < 100 then 'noInstability' when b_at is not null then 'capBreaks' when never then 'openButWeak' else 'cappedAllDay' end as verdict, case when hourly then 'hourly' else 'multiHour' end as cadence, step_h, floor(mc + 0.5) as peak_cape_jkg, case when mc > 0 then mc_at end as peak_cape_at,
 case when mc >= 100 and hourly then b_at end as breaks_at, case when mc >= 100 and not hourly and bb[2] is null then b_at end as already_open_at, case when mc >= 100 and not hourly then bb[2] end as breaks_after, case when mc >= 100 and not hourly and bb[2] is not null then b_at end as breaks_by, case when mc >= 100 then floor(b_cape + 0.5) end as cape_at_break_jkg from g""",
)
def f05_cap_timing(spark, d):
    return at_utc(findings.cap_timing(profile_hours(spark, d)), "peak_cape_at", "breaks_at", "already_open_at", "breaks_after", "breaks_by")


@R.add(
    "f11_band_shear",
    f"""with {PROFILE}, wd as (select *, first(day) over (partition by profile_id, window_id order by i) as wday from wh),
bd as (select wd.profile_id, wday as day, wd.i, wd.valid_at, l.height_m, l.wind_speed_mps as s, -l.wind_speed_mps * sin(l.wind_direction_deg * pi() / 180) as u, -l.wind_speed_mps * cos(l.wind_direction_deg * pi() / 180) as v from wd join l using (hour_id) join o using (hour_id) where l.height_m > o.model_elevation_m + 20 and l.height_m between wd.launch_m and wd.lift_top),
pr as (select *, lead(height_m) over x as z2, lead(u) over x as u2, lead(v) over x as v2, lead(s) over x as s2, count(*) over (partition by profile_id, i) as n, row_number() over x as k from bd window x as (partition by profile_id, i order by height_m)),
rs as (select *, sqrt((u2 - u) * (u2 - u) + (v2 - v) * (v2 - v)) as sh, sqrt((u2 - u) * (u2 - u) + (v2 - v) * (v2 - v)) / ((z2 - height_m) / 1000) as rate from pr where z2 - height_m >= 30),
gb_ as (select profile_id, day, arg_min((rate, sh, valid_at, height_m, z2, n, s, s2), (-rate, i, k)) as m from rs group by profile_id, day)
select profile_id, day, {R2.format('m[1]')} as rate_per_km, {R2.format('m[2]')} as shear_mps, m[3] as at, {R1.format('m[4]')} as from_m, {R1.format('m[5]')} as to_m, m[6]::int as levels_in_band, m[7] < 2 and m[8] < 2 as both_under_floor from gb_""",
)
def f11_band_shear(spark, d):
    return at_utc(findings.band_shear(profile_hours(spark, d)), "at")


@R.add(
    "f14_terrain_mismatch",
    f"""with {PROFILE}, h2 as (select *, 600.0::double as site_m from hp), g as (select profile_id, any_value(profile_elevation_m) as model_elevation_m, max(lift_top) as mt, arg_min(valid_at, (-lift_top, i)) filter (lift_top is not null) as top_at from h2 group by profile_id)
select profile_id, model_elevation_m, 600.0::double as launch_m, {R1.format('(model_elevation_m - 600)')} as delta_m, coalesce(mt > 600, false) as ever_reaches_launch, {R1.format('mt')} as max_top_m, top_at from g where abs(model_elevation_m - 600) >= 250""",
)
def f14_terrain_mismatch(spark, d):
    return at_utc(findings.terrain_mismatch(profile_hours(spark, d).withColumn("launch_m", F.lit(600.0))), "top_at")


@R.add("f13_data_caveats", f"with {PROFILE} select profile_id, concat_ws(',', case when bool_and(lift_top is null) then 'usable_lift_top_m' end, case when bool_and(bl_top is null) then 'boundary_layer_top_m' end) as absent, count(*) filter (lift_top is null) as null_lift_hours, max(after_h) as widest_step_h, count(*) as n_hours from hp group by profile_id")
def f13_data_caveats(spark, d):
    return findings.data_caveats(profile_hours(spark, d), ("usable_lift_top_m", "boundary_layer_top_m"))
