"""Findings of ensembles, of wind and of whole days, and run trajectories, over the pooled profiles and an ensemble made of vectors."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ridgelift.functions import times
from ridgelift.operators import compare, day_findings, ensemble, ensemble_findings, findings, trajectories, wind_findings
from ridgelift.operators.ensemble import POINTS
from ridgelift.sources.projections import MEMBERS, member_value

from .compare import BENCHED, VOTES, _benched, _sited, _windows
from .findings import PROFILE, R1, R2, REFERENCE, ZONE, at_utc, profile_hours, shared_hours
from .registry import Registry

R = Registry()
R0 = "floor(({}) + 0.5)"
START = "2024-06-01 00:00:00"


def ensemble_hours(spark, d):
    """Forty hours a profile, the last ten three hours apart: both quantities of every member from one vector."""
    m = member_value(spark, d)
    k, v = F.col("hour_id"), F.col("v")
    w = ensemble.block(m.withColumn("x", F.abs(v) * 0.08), ["hour_id"], "x").select("hour_id", F.col("members").alias("w_members"), *[F.col(f"p{p}").alias(f"w_p{p}") for p in POINTS])
    high = F.when((k * 3 + F.col("member")) % 7 != 0, F.abs(v) * 30 + 500)
    tops = m.withColumn("x", high)
    top = ensemble.block(tops, ["hour_id"], "x").select("hour_id", F.col("members").alias("top_members"), *[F.col(f"p{p}").alias(f"top_p{p}") for p in POINTS])
    full = tops.groupBy("hour_id").agg(ensemble.ceiled(F.col("x"), 500.0 + F.col("member") % 20 * 60).alias("top_ceiled"))
    place = k % 40
    hours = F.when(place < 30, place).otherwise(30 + (place - 30) * 3)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + hours * 3600)
    h = w.join(top, "hour_id").join(full, "hour_id").select(F.floor(k / 40).alias("profile_id"), "*", at.alias("valid_at"), F.lit(500.0).alias("launch_m"), F.lit("2024-05-31 18:00:00").cast("timestamp").alias("reference_time"))
    h = h.withColumn("day", times.local_day(F.col("valid_at"), ZONE)).withColumn("local_hour", times.local_hour(F.col("valid_at"), ZONE))
    return findings.prepared(h)


def _blocks(name, x):
    return f"{name}_b as (select hour_id, count(x)::int as {name}_members, {', '.join(f'quantile_cont(x, {p / 100}) as {name}_p{p}' for p in POINTS)} from (select hour_id, member, {x} as x from m) s group by hour_id)"


TOP = "case when (hour_id * 3 + member) % 7 <> 0 then abs(v) * 30 + 500 end"
ENSEMBLE = f"""{MEMBERS}, {_blocks('w', 'abs(v) * 0.08::double')}, {_blocks('top', TOP)}, ce as (select hour_id, count(*) filter (({TOP}) >= 500.0 + member % 20 * 60 - 0.5) as top_ceiled from m group by hour_id),
e0 as (select hour_id // 40 as profile_id, *, timestamp '{START}' + (case when hour_id % 40 < 30 then hour_id % 40 else 30 + (hour_id % 40 - 30) * 3 end)::int * interval 1 hour as valid_at from w_b join top_b using (hour_id) join ce using (hour_id)),
e1 as (select *, row_number() over o - 1 as i, lag(valid_at) over o as pv, lead(valid_at) over o as nv, strftime(valid_at at time zone 'UTC' at time zone '{ZONE}', '%Y-%m-%d') as day, hour(valid_at at time zone 'UTC' at time zone '{ZONE}') as local_hour from e0 window o as (partition by profile_id order by valid_at, hour_id)),
e2 as (select *, greatest(1.0, floor((epoch_us(nv) - epoch_us(valid_at)) / 3.6e9 + 0.5)) as ga, greatest(1.0, floor((epoch_us(valid_at) - epoch_us(pv)) / 3.6e9 + 0.5)) as gb from e1),
eh as (select *, coalesce(case when nv is not null then ga end, gb, 1.0) as after_h, coalesce(case when pv is not null then gb end, ga, 1.0) as before_h from e2)"""
LEAD = "floor((epoch_us({at}) - epoch_us(timestamp '{ref}')) / 3.6e9 * 10 + 0.5) / 10"


def _ok(p):
    return f"(coalesce(w_p{p} >= 0.9 and top_p{p} - 500 >= 300, false))"


_FIRST = "coalesce(" + ", ".join(f"case when steps_p{p} > 0 then {{of{p}}} end" for p in POINTS) + ")"
F02 = f"""with {ENSEMBLE}, g as (select profile_id, day, max(after_h) filter ({' or '.join(_ok(p) for p in POINTS)}) as step_h,
 {', '.join(f'count(*) filter ({_ok(p)}) as steps_p{p}, min(least(w_members, top_members)) filter ({_ok(p)}) as members_min_p{p}, max(top_ceiled) filter ({_ok(p)}) as ceiled_max_p{p}, arg_min(valid_at, (-top_p{p}, i)) filter ({_ok(p)}) as at_p{p}' for p in POINTS)} from eh group by all)
select profile_id, day, {LEAD.format(at=_FIRST.format(**{f'of{p}': f'at_p{p}' for p in POINTS}), ref='2024-05-31 18:00:00')} as lead_h, {_FIRST.format(**{f'of{p}': f"'p{p}'" for p in POINTS})} as minimal, step_h,
 {', '.join(f'steps_p{p}, members_min_p{p}, ceiled_max_p{p}' for p in POINTS)} from g where {' or '.join(f'(steps_p{p} > 0) <> (steps_p50 > 0)' for p in POINTS)}"""


@R.add("f02_percentile_crossing", F02)
def f02_percentile_crossing(spark, d):
    r = ensemble_findings.percentile_crossings(ensemble_hours(spark, d))
    return r.select("profile_id", "day", "lead_h", "minimal", "step_h", *[f"{c}_p{p}" for p in POINTS for c in ("steps", "members_min", "ceiled_max")])


QUANTITIES = {"thermalVelocityMps": "w_members", "usableLiftTopM": "top_members"}


@R.add(
    "f12_membership",
    f"""with {ENSEMBLE}, q as (select profile_id, i, 'thermalVelocityMps' as quantity, w_members as n from eh union all select profile_id, i, 'usableLiftTopM', top_members from eh), f as (select profile_id, max(n) as declared_members from q group by 1)
select profile_id, quantity, declared_members, min(n) filter (n < declared_members) as min_members, count(*) filter (n < declared_members) as hours_below_full, count(*) as of_hours from q join f using (profile_id) group by all having count(*) filter (n < declared_members) > 0""",
)
def f12_membership(spark, d):
    return ensemble_findings.membership(ensemble_hours(spark, d), QUANTITIES).drop("examples")


@R.add(
    "t06_first_examples",
    f"""with {ENSEMBLE}, q as (select profile_id, i, valid_at, 'thermalVelocityMps' as quantity, w_members as n from eh union all select profile_id, i, valid_at, 'usableLiftTopM', top_members from eh), f as (select profile_id, max(n) as full_n from q group by 1)
select profile_id, quantity, valid_at, n as members from q join f using (profile_id) where n < full_n qualify row_number() over (partition by profile_id, quantity order by i) <= 4""",
)
def t06_first_examples(spark, d):
    x = ensemble_findings.membership(ensemble_hours(spark, d), QUANTITIES).select("profile_id", "quantity", F.explode("examples").alias("e"))
    return at_utc(x.select("profile_id", "quantity", "e.valid_at", "e.members"), "valid_at")


@R.add(
    "f12_band_widths",
    f"""with {ENSEMBLE}, q as (select profile_id, 'thermalVelocityMps' as series, w_p90 - w_p10 as x from eh where w_p50 is not null union all select profile_id, 'usableLiftTopM', top_p90 - top_p10 from eh where top_p50 is not null),
g as (select profile_id, series, count(*) as hours_with_signal, list_sort(list(x))[count(*) // 2 + 1] as med from q group by all)
select profile_id, series, hours_with_signal, case when series = 'thermalVelocityMps' then {R2.format('med')} else {R1.format('med')} end as median_width from g""",
)
def f12_band_widths(spark, d):
    return ensemble_findings.band_widths(ensemble_hours(spark, d))


@R.add(
    "f12_day_bands",
    f"""with {ENSEMBLE}, g as (select profile_id, day, arg_min((valid_at, w_p90 - w_p10, top_p90 - top_p10), (-w_p50, i)) filter (w_p50 is not null) as p, arg_min(local_hour < before_h, i) and arg_max(local_hour >= 24 - after_h, i) as whole from eh group by all)
select profile_id, day, p[1] as peak_at, {LEAD.format(at='p[1]', ref='2024-05-31 18:00:00')} as lead_h, {R2.format('p[2]')} as wstar_width_mps, {R1.format('p[3]')} as top_width_m, not whole as truncated from g where p is not null""",
)
def f12_day_bands(spark, d):
    return at_utc(ensemble_findings.day_bands(ensemble_hours(spark, d)), "peak_at")


STRONG = """bl as (select hp.*, mb.bw, mb.bx from hp left join (select hp.hour_id, max(l.wind_speed_mps) as bw, arg_min((l.height_m, l.pressure_hpa, l.wind_direction_deg), (-l.wind_speed_mps, l.height_m)) as bx from hp join l using (hour_id) join o using (hour_id)
  where l.height_m > o.model_elevation_m + 20 and l.height_m between hp.launch_m - 200 and hp.lift_top + 200 group by hp.hour_id) mb using (hour_id)),
wb as (select bl.*, window_id, first(bl.day) over (partition by bl.profile_id, window_id order by bl.i) as wday from wh join bl using (hour_id))"""
_G = "arg_min((gust, sw, valid_at), (-gust, i)) filter (gust is not null) as g, arg_min((bw, bx[1], bx[2], bx[3], valid_at, i), (-bw, i)) filter (bw is not null) as b"
SUMMARY = f"""{PROFILE}, {STRONG}, pk as (select profile_id, day, {_G} from bl group by all), jn as (select bl.profile_id, bl.day, bl.i, after_h, b, coalesce(bw >= b[1] * 0.8, false) as on_ from bl join pk using (profile_id, day)),
cg as (select *, case when on_ <> lag(on_) over (partition by profile_id, day order by i) then 1 else 0 end as ch from jn), rn as (select *, sum(ch) over (partition by profile_id, day order by i rows unbounded preceding) as run from cg),
ls as (select profile_id, day, sum(after_h) as persistence_h from rn group by profile_id, day, run having bool_or(i = b[6])), wk as (select profile_id, wday as day, {_G} from wb group by all),
sm as (select pk.profile_id, pk.day, {R2.format('pk.g[1]')} as gust_mps, {R2.format('pk.g[2]')} as gust_mean_mps, pk.g[3] as gust_at, {R2.format('pk.b[1]')} as band_mps, {R0.format('pk.b[4]')} as band_direction_deg, {R1.format('pk.b[2]')} as band_height_m, pk.b[5] as band_at, pk.b[3] as band_pressure_hpa, persistence_h,
 wk.profile_id is not null as in_window, {R2.format('wk.g[1]')} as window_gust_mps, {R2.format('wk.g[2]')} as window_gust_mean_mps, wk.g[3] as window_gust_at, {R2.format('wk.b[1]')} as window_band_mps, {R0.format('wk.b[4]')} as window_band_direction_deg, {R1.format('wk.b[2]')} as window_band_height_m, wk.b[5] as window_band_at
 from pk left join ls using (profile_id, day) left join wk using (profile_id, day) where pk.g is not null or pk.b is not null or wk.profile_id is not null)"""


@R.add("f08_wind_summary", f"with {SUMMARY} select * from sm")
def f08_wind_summary(spark, d):
    return at_utc(wind_findings.wind_summaries(shared_hours(spark, d, levels=True)), "gust_at", "band_at", "window_gust_at", "window_band_at")


@R.add(
    "f09_wind_exceedance",
    f"""with {PROFILE}, {STRONG}, st as (select profile_id, wday, max(after_h) as step_h from wb group by all),
qv as (select profile_id, wday, i, valid_at, after_h, 'surfaceWind' as quantity, 7.0::double as threshold_mps, sw as v from wb union all select profile_id, wday, i, valid_at, after_h, 'gust', 11.0::double, gust from wb union all select profile_id, wday, i, valid_at, after_h, 'bandWind', 15.0::double, bw from wb),
ex as (select *, case when i <> lag(i) over (partition by profile_id, wday, quantity order by i) + 1 then 1 else 0 end as apart from qv where v >= threshold_mps), rx as (select *, sum(apart) over (partition by profile_id, wday, quantity order by i rows unbounded preceding) as run_id from ex)
select profile_id, wday as day, quantity, threshold_mps, run_id::bigint as run_id, min(valid_at) as start_at, max(valid_at) as end_at, sum(after_h) as hours, {R2.format('max(v)')} as peak_mps, arg_min(valid_at, (-v, i)) as peak_at, any_value(step_h) as step_h from rx join st using (profile_id, wday) group by profile_id, wday, quantity, threshold_mps, run_id""",
)
def f09_wind_exceedance(spark, d):
    return at_utc(wind_findings.wind_exceedances(profile_hours(spark, d, wind_findings.banded), surface_mps=7.0, gust_mps=11.0, band_mps=15.0), "start_at", "end_at", "peak_at")


_U, _V = "-{s} * sin({d} * pi() / 180)", "-{s} * cos({d} * pi() / 180)"
_DEG = "floor(round((atan2(-{u}, -{v}) / (pi() / 180) % 360 + 360) % 360, 6) + 0.5)"
DIRECTIONS = f"""{PROFILE}, wo as (select *, first(day) over (partition by profile_id, window_id order by i) as wday from wh),
gd as (select profile_id, window_id, any_value(wday) as day, arg_min((sw, sd), i) as a, arg_min((sw, sd, valid_at), (-lift_top, i)) as p, arg_max((sw, sd), i) as b, avg({_U.format(s='sw', d='sd')}) as u, avg({_V.format(s='sw', d='sd')}) as v, count(sd) filter (sw is not null) as samples from wo group by profile_id, window_id),
bd_ as (select wh.profile_id, wh.window_id, avg({_U.format(s='l.wind_speed_mps', d='l.wind_direction_deg')}) as bu, avg({_V.format(s='l.wind_speed_mps', d='l.wind_direction_deg')}) as bv, count(*) as band_samples from wh join l using (hour_id) join o using (hour_id) where l.height_m > o.model_elevation_m + 20 and l.height_m between wh.launch_m and wh.lift_top group by all),
wy as (select *, case when a[1] >= 1 then a[2] end as ad, case when p[1] >= 1 then p[2] end as pd, case when b[1] >= 1 then b[2] end as bd from gd where a[1] is not null and p[1] is not null and b[1] is not null and samples > 0),
wd_ as (select wy.profile_id, wy.window_id::bigint as window_id, day, {R2.format('a[1]')} as start_mps, {R0.format('ad')} as start_deg, {R2.format('p[1]')} as peak_mps, {R0.format('pd')} as peak_deg, {R2.format('b[1]')} as end_mps, {R0.format('bd')} as end_deg, p[3] as peak_at,
 floor(-((((ad - bd + 180) % 360 + 360) % 360) - 180) + 0.5) as net_veer_deg, {R2.format('sqrt(u * u + v * v)')} as surface_mps, case when round(sqrt(u * u + v * v), 9) >= 1 then {_DEG.format(u='u', v='v')} end as surface_deg, samples,
 {R2.format('sqrt(bu * bu + bv * bv)')} as band_mps, case when round(sqrt(bu * bu + bv * bv), 9) >= 1 then {_DEG.format(u='bu', v='bv')} end as band_deg, band_samples from wy left join bd_ using (profile_id, window_id))"""


@R.add("f10_wind_direction", f"with {DIRECTIONS} select * from wd_")
def f10_wind_direction(spark, d):
    return at_utc(wind_findings.wind_directions(profile_hours(spark, d)), "peak_at")


def smoke_hours(h):
    """A smoke document at three of four hours."""
    k = F.col("hour_id")
    return h.where(k % 4 != 0).select("profile_id", "valid_at", ((k * 31 % 900).cast("double") / 10.0).alias("surface_ugm3"), F.when(k % 9 != 0, (k * 17 % 3000).cast("double") / 10.0).alias("column_mgm2"), k.alias("seq"))


@R.add(
    "f06_j02_smoke_impact",
    f"""with {PROFILE}, sk as (select profile_id, valid_at, arg_max(((hour_id * 31) % 900)::double / 10.0::double, hour_id) as s, max_by(case when hour_id % 9 <> 0 then ((hour_id * 17) % 3000)::double / 10.0::double else -1 end, hour_id) as c from hp where hour_id % 4 <> 0 group by all),
wo as (select profile_id, i, first(day) over (partition by profile_id, window_id order by i) as wday from wh), jn as (select hp.profile_id, hp.day, hp.i, hp.valid_at, s, c, wo.i is not null as inside from hp join sk using (profile_id, valid_at) left join wo on wo.profile_id = hp.profile_id and wo.i = hp.i and wo.wday = hp.day where c >= 0),
ph_ as (select profile_id, day, count(*) as profile_hours from hp group by all)
select profile_id, day, 'joined' as source, {R1.format('max(s)')} as peak_surface_ugm3, arg_min(valid_at, (-s, i)) as peak_surface_at, {R1.format('max(c)')} as peak_companion, arg_min(valid_at, (-c, i)) as peak_companion_at, {R1.format('max(s) filter (inside)')} as window_surface_ugm3, {R1.format('max(c) filter (inside)')} as window_companion, count(*) as joined_hours, any_value(profile_hours) as profile_hours
from jn join ph_ using (profile_id, day) group by profile_id, day""",
)
def f06_j02_smoke_impact(spark, d):
    h = profile_hours(spark, d)
    return at_utc(day_findings.smoke_impact(h, smoke_hours(h)), "peak_surface_at", "peak_companion_at")


@R.add(
    "f07_convective_day",
    f"""with {PROFILE}, hc as (select *, case when profile_id % 3 = 0 then cin end as cn, epoch_us(valid_at) - epoch_us(lag(valid_at) over (partition by profile_id, day order by i)) as gap from hp), nc as (select profile_id from hc group by 1 having count(cn) = 0),
g as (select profile_id, day, count(*) as n, coalesce(bool_and(gap = 3600000000), false) as hourly, max(cape) as mc, arg_min(valid_at, (-cape, i)) as mc_at, min(valid_at) filter (rain > 0.2) as precip_starts_at, {R2.format('max(rain) filter (rain > 0.2)')} as peak_precip_mm_hr,
 case when count(*) filter (rain > 0.2) = 0 and count(rain) > 0 then true end as no_precip_above_threshold, sum(after_h) as covered_h, arg_min(local_hour < before_h, i) and arg_max(local_hour >= 24 - after_h, i) as whole from hc where profile_id in (select profile_id from nc) group by profile_id, day),
we as (select profile_id, window_id, arg_min(day, i) as day, max(valid_at) as e from wh group by all), wx as (select profile_id, day, max(e) as window_ends_at from we group by all)
select profile_id, day, floor(mc + 0.5) as peak_cape_jkg, case when mc > 0 then mc_at end as peak_cape_at, precip_starts_at, peak_precip_mm_hr, no_precip_above_threshold, window_ends_at, covered_h, not whole as truncated from g left join wx using (profile_id, day) where n >= 2 and hourly""",
)
def f07_convective_day(spark, d):
    h = profile_hours(spark, d).withColumn("cin_jkg", F.when(F.col("profile_id") % 3 == 0, F.col("cin_jkg")))
    return at_utc(day_findings.convective_days(h), "peak_cape_at", "precip_starts_at", "window_ends_at")


@R.add(
    "f03_quiet_day_context",
    f"""with {PROFILE}, qd as (select * from hp where not exists (select 1 from wh where wh.profile_id = hp.profile_id and wh.day = hp.day)),
g as (select profile_id, day, arg_min((valid_at, cloud), (-w, i)) filter (w is not null) as pw, arg_min(valid_at, (-(lift_top - launch_m), i)) filter (lift_top is not null) as pd, min(valid_at) as first_at, floor(round(avg(cloud) filter (local_hour between 10 and 16), 6) * 10 + 0.5) / 10 as daytime_cloud_pct,
 {R2.format('max(rain) filter (rain > 0.2)')} as peak_precip_mm_hr, arg_min(valid_at, (-rain, i)) filter (rain > 0.2) as peak_precip_at, min(valid_at) filter (rain > 0.2) as first_wet_at, sum(after_h) filter (rain > 0.2) as wet_hours, case when count(*) filter (rain > 0.2) > 0 then max(before_h) end as precip_step_h,
 {R2.format('max(gust)')} as max_gust_mps, arg_min(valid_at, (-gust, i)) filter (gust is not null) as max_gust_at, {R1.format('max(flux)')} as peak_heat_flux_wm2, arg_min(valid_at, (-flux, i)) as peak_heat_flux_at from qd group by profile_id, day)
select profile_id, day, {LEAD.format(at='coalesce(pw[1], pd, first_at)', ref=REFERENCE)} as lead_h, {R1.format('pw[2]')} as cloud_at_peak_pct, daytime_cloud_pct, peak_precip_mm_hr, peak_precip_at, first_wet_at, wet_hours, precip_step_h, max_gust_mps, max_gust_at, peak_heat_flux_wm2, peak_heat_flux_at from g""",
)
def f03_quiet_day_context(spark, d):
    r = day_findings.quiet_day_context(profile_hours(spark, d)).select("profile_id", "day", "lead_h", "cloud_at_peak_pct", "daytime_cloud_pct", "peak_precip_mm_hr", "peak_precip_at", "first_wet_at", "wet_hours", "precip_step_h", "max_gust_mps", "max_gust_at", "peak_heat_flux_wm2", "peak_heat_flux_at")
    return at_utc(r, "peak_precip_at", "first_wet_at", "max_gust_at", "peak_heat_flux_at")


# Run trajectories: the five members of a site stand for five runs, six hours apart.


def _runs(h):
    runs = _sited(h).select("site", "member").distinct()
    return runs.withColumn("reference_time", F.timestamp_seconds(F.unix_timestamp(F.lit(REFERENCE).cast("timestamp")) + F.col("member") * 21600))


REF = f"timestamp '{REFERENCE}' + member::int * interval 6 hour"
NOON = "(day::timestamp + interval 12 hour) at time zone '" + ZONE + "' at time zone 'UTC'"
LEADS = f"floor((epoch_us({NOON}) - epoch_us({REF})) / 3.6e9 * 10 + 0.5) / 10"
RUNS = f"""{VOTES}, ru as (select distinct site, member from cv), vd as (select vw.*, dh as duration_h, st as step_h, od as own_day from vw join (select profile_id, window_id, sum(after_h) as dh, max(after_h) as st, arg_min(day, i) as od from wh group by all) using (profile_id, window_id)),
qf as (select profile_id % 50 as site, profile_id // 50 as member, day, case when coalesce(max(w) < 0.9, true) and coalesce(max(lift_top - launch_m) < 300, true) then 'wstar,depth' when coalesce(max(w) < 0.9, true) then 'wstar' when coalesce(max(lift_top - launch_m) < 300, true) then 'depth' else 'coincidence' end as failed from qs group by all)"""


@R.add(
    "c10_c15_existence_trajectory",
    f"""with {RUNS}, ds as (select distinct site, day from cv), wv as (select site, member, day, arg_min(pw, (abs(pw - 0.9), pw)) as ww, arg_min(ph, (abs(ph - 300), ph)) as wd from vd group by all),
xv as (select ds.site, ds.day, ru.member, ww, wd, wv.site is not null as is_w, qd.pw as qw, qd.md as qdp, qd.site is not null as is_q, truncated, failed from ds join ru using (site) left join wv using (site, member, day) left join qd using (site, member, day) left join qf using (site, member, day))
select site, day, member, {REF} as reference_time, {LEADS} as lead_h, case when is_w then 'window' when is_q and not truncated then 'quiet' else 'abstained' end as vote, case when not is_w and is_q and not truncated then failed end as failed,
 case when not is_w then case when is_q and truncated then 'truncatedDay' when not is_q then 'outOfHorizon' end end as abstained, case when is_w then ww when is_q and not truncated then qw end as wstar_flip_at_mps, case when is_w then wd when is_q and not truncated then qdp end as depth_flip_at_m from xv""",
)
def c10_c15_existence_trajectory(spark, d):
    h = shared_hours(spark, d)
    covered = _sited(h).select("site", "member", "day").distinct()
    return at_utc(trajectories.existence(covered, _windows(h), _sited(findings.quiet_days(h)), _runs(h), ZONE), "reference_time")


@R.add(
    "c16_compare_board",
    f"""with {RUNS}, {BENCHED}, ds as (select distinct site, day from cv), me as (select distinct site, member from cv), md as (select *, day::timestamp at time zone '{ZONE}' at time zone 'UTC' as d0, (day::date + 1)::timestamp at time zone '{ZONE}' at time zone 'UTC' as d1 from vd),
sp as (select site, member, day, greatest(sa, d0) as s, least(ea + (greatest(1, step_h) * 60)::int * interval 1 minute, d1) as e from md), mg as (select *, case when s <= max(e) over (partition by site, member, day order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as brk from sp where s < e),
il as (select *, sum(brk) over (partition by site, member, day order by s, e rows unbounded preceding) as k from mg), un as (select site, member, day, k, min(s) as s, max(e) as e from il group by all), ag as (select site, member, day, count(*) as spans, sum(epoch_us(e) - epoch_us(s)) / 3.6e9 as lit_h, min(s) as first_at, max(e) as last_at from un group by all),
lt as (select profile_id % 50 as site, profile_id // 50 as member, window_id, floor(max(lift_top) * 10 + 0.5) / 10 as top from wh group by all),
wt as (select site, member, day, max(top) filter (own_day = day) as peak_lift_top_m, min(own_day) filter (own_day <> day) as via from vd join lt using (site, member, window_id) group by all)
select site, day, member, case when bn.site is not null then 'benched' when wt.site is not null then 'window' when not truncated then 'quiet' else 'abstained' end as vote, case when bn.site is null and wt.site is null and coalesce(truncated, true) then case when truncated then 'truncatedDay' else 'outOfHorizon' end end as abstained,
 case when bn.site is null and wt.site is null and not truncated then failed end as failed, coalesce(spans, 0) as spans, round(lit_h, 6) as lit_h, first_at, last_at, peak_lift_top_m, via
from ds join me using (site) left join ag using (site, member, day) left join wt using (site, member, day) left join qd using (site, member, day) left join qf using (site, member, day) left join bn using (site, member)""",
)
def c16_compare_board(spark, d):
    h = shared_hours(spark, d)
    windows = _windows(h)
    b = compare.board(_sited(h).select("site", "member", "day").distinct(), windows, _sited(findings.quiet_days(h)), _benched(h), ZONE)
    return at_utc(b.drop("peak_at").withColumn("lit_h", F.round("lit_h", 6)), "first_at", "last_at")


@R.add(
    "c11_timing_trajectory",
    f"""with {RUNS}, pm as (select site, day, member, arg_min((sa, cs, step_h), sa) as s, arg_max((ea, ce, step_h), ea) as e from vd group by all),
eg as (select site, day, member, 'start' as edge, s[1] as edge_at, s[2] as clipped, s[3] as step_h from pm union all select site, day, member, 'end', e[1], e[2], e[3] from pm),
ek as (select site, day, member, edge, edge_at, step_h from eg where not clipped and strftime(edge_at at time zone 'UTC' at time zone '{ZONE}', '%Y-%m-%d') = day),
ed as (select site, day, edge, case when count(*) >= 2 then floor((max(epoch_us(edge_at) / 3.6e9) - min(epoch_us(edge_at) / 3.6e9)) * 10 + 0.5) / 10 end as spread_h, max(step_h) as step_h_max from ek group by all)
select site, day, member, edge, edge_at as "at", step_h, spread_h, step_h_max, {REF} as reference_time, {LEADS} as lead_h from ek join ed using (site, day, edge)""",
)
def c11_timing_trajectory(spark, d):
    h = shared_hours(spark, d)
    return at_utc(trajectories.edges(_windows(h), _runs(h), ZONE, first_of_equal_ends=True), "at", "reference_time")


@R.add(
    "c12_magnitude_trajectory",
    f"""with {RUNS}, wv as (select site, day, member, max(pw) filter (own_day = day) as peak_wstar_mps, max(ph) filter (pday = day) as peak_above_launch_m, floor(sum(duration_h) filter (own_day = day) * 10 + 0.5) / 10 as duration_h from vd group by all),
rr as (select site, day, member, peak_wstar_mps, peak_above_launch_m, duration_h, 'window' as vote from wv union all select site, day, member, pw, md, null, 'quiet' from qd where not truncated and (site, day, member) not in (select site, day, member from wv))
select *, {REF} as reference_time, {LEADS} as lead_h from rr""",
)
def c12_magnitude_trajectory(spark, d):
    h = shared_hours(spark, d)
    return at_utc(trajectories.magnitude(_windows(h), _sited(findings.quiet_days(h)), _runs(h), ZONE), "reference_time")


@R.add(
    "c07_wind_divergence",
    f"""with {SUMMARY}, tw as (select distinct profile_id % 50 as site, day, profile_id // 50 as member from wh),
xv as (select tw.site, tw.day, tw.member, case when in_window then window_band_mps else band_mps end as bw, case when in_window then window_gust_mps else gust_mps end as gu from tw join sm on sm.profile_id % 50 = tw.site and sm.profile_id // 50 = tw.member and sm.day = tw.day),
gg as (select site, day, count(bw) as band_members, case when count(bw) >= 2 then floor(round(max(bw) - min(bw), 6) * 100 + 0.5) / 100 end as band_spread_mps, count(gu) filter (member % 2 = 0) as hour_max_members, case when count(gu) filter (member % 2 = 0) >= 2 then floor(round(max(gu) filter (member % 2 = 0) - min(gu) filter (member % 2 = 0), 6) * 100 + 0.5) / 100 end as hour_max_spread_mps,
 count(gu) filter (member = 1) as instant_members, case when count(gu) filter (member = 1) >= 2 then 0.0::double end as instant_spread_mps, count(gu) filter (member = 3) as undeclared_members from xv group by all),
zz as (select * from gg where band_members >= 2 or hour_max_members >= 2 or instant_members >= 2) select * from zz""",
)
def c07_wind_divergence(spark, d):
    h = shared_hours(spark, d, levels=True)
    members = _sited(findings.window_hours(h)).select("site", "member", "day").distinct()
    kind = F.when(F.col("member") % 2 == 0, "hourMax").when(F.col("member") == 1, "instant")
    return trajectories.wind_divergence(members, _sited(wind_findings.wind_summaries(h)).withColumn("gust_kind", kind))


@R.add(
    "c08_direction_spread",
    f"""with {DIRECTIONS}, g as (select profile_id % 50 as site, day, profile_id // 50 as member, sum({_U.format(s='surface_mps', d='surface_deg')} * samples) / sum(samples) as u, sum({_V.format(s='surface_mps', d='surface_deg')} * samples) / sum(samples) as v from wd_ where surface_deg is not null group by all),
en as (select site, day, member, {_DEG.format(u='u', v='v')} as deg from g where round(sqrt(u * u + v * v), 9) >= 1), cn as (select site, day, count(*) as members from en group by all),
pr_ as (select a.site, a.day, a.member as first_member, b.member as second_member, 180 - abs(abs(a.deg - b.deg) - 180) as sep from en a join en b on a.site = b.site and a.day = b.day and a.member < b.member)
select site, day, any_value(members) as members, max(sep) as separation_deg, arg_min(first_member, (-sep, first_member, second_member)) as first_member, arg_min(second_member, (-sep, first_member, second_member)) as second_member from pr_ join cn using (site, day) group by site, day""",
)
def c08_direction_spread(spark, d):
    w = _sited(wind_findings.surface_directions(profile_hours(spark, d)))  # a row a window: kept, as it is read several times
    return trajectories.direction_spread(w.select("site", "member", "day", "surface_mps", "surface_deg", "samples").persist(StorageLevel.MEMORY_AND_DISK))
