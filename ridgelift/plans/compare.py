"""Comparisons: five members at each of fifty pooled sites; runs and their revisions; joins and sets of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.functions import times
from ridgelift.operators import compare, findings, sequences, station
from ridgelift.sources.projections import HISTORY, HOURS, forecast_hour, station_history, table

from .findings import PROFILE, R1, R2, ZONE, at_utc, profile_hours, shared_hours
from .registry import Registry

R = Registry()
SITE = {"site": "profile_id % 50", "member": "floor(profile_id / 50)"}


def _sited(df):
    return df.withColumn("site", F.col("profile_id") % 50).withColumn("member", F.floor(F.col("profile_id") / 50))


def _windows(h):
    """One row per window and day it touches."""
    w = findings.thermal_windows(h, also=(F.collect_set("day").alias("touched"),)).withColumnRenamed("day", "own_day")
    return _sited(w.withColumn("day", F.explode("touched")).drop("touched"))


DAY_OF = "strftime({} at time zone 'UTC' at time zone '" + ZONE + "', '%Y-%m-%d')"
VOTES = f"""{PROFILE}, tw as (select profile_id, window_id, {R2.format('max(w)')} as pw, {R1.format('max(lift_top) - any_value(launch_m)')} as ph, arg_min(day, (-lift_top, i)) as pday, min(valid_at) as sa, max(valid_at) as ea, min(i) = 0 as cs, max(i) as li from wh group by 1, 2),
td as (select distinct profile_id, window_id, day from wh), mx as (select profile_id, max(i) as last_i from hp group by 1), vw as (select profile_id % 50 as site, profile_id // 50 as member, td.day, tw.*, li = last_i as ce from td join tw using (profile_id, window_id) join mx using (profile_id)),
qs as (select * from hp where not exists (select 1 from wh where wh.profile_id = hp.profile_id and wh.day = hp.day)),
qd as (select profile_id % 50 as site, profile_id // 50 as member, day, {R2.format('max(w)')} as pw, {R1.format('max(lift_top - launch_m)')} as md, not (arg_min(local_hour < before_h, i) and arg_max(local_hour >= 24 - after_h, i)) as truncated from qs group by profile_id, day),
cv as (select distinct profile_id % 50 as site, profile_id // 50 as member, day from hp)"""


BENCHED = "bn as (select profile_id % 50 as site, profile_id // 50 as member, floor((any_value(profile_elevation_m) - any_value(launch_m)) * 10 + 0.5) / 10 as delta_m from hp group by profile_id having abs(any_value(profile_elevation_m) - any_value(launch_m)) >= 250 and not coalesce(max(lift_top) > any_value(launch_m), false))"


def _benched(h):
    return compare.benched(_sited(findings.terrain_mismatch(h)))


@R.add(
    "c03_window_agreement",
    f"""with {VOTES}, {BENCHED}, ac as (select * from cv where (site, member) not in (select site, member from bn)), aw as (select * from vw where (site, member) not in (select site, member from bn)), aq as (select * from qd where (site, member) not in (select site, member from bn)),
ms as (select site, count(distinct member) as members from ac group by site), pz as (select site, day, count(distinct member) as present from ac group by all), ds as (select distinct site, day from cv),
wv as (select site, day, count(distinct member) as wm from aw group by all), qv as (select site, day, count(*) filter (not truncated) as nq, count(*) filter (truncated) as nt from aq group by all),
un as (select site, day, pw, ph from aw union all select site, day, pw, md as ph from aq where not truncated), fl as (select site, day, arg_min(pw, (abs(pw - 0.9), pw)) filter (pw is not null) as flip, arg_min(ph, (abs(ph - 300), ph)) filter (ph is not null) as flop from un group by all)
select site, day, coalesce(wm, 0) as window_members, coalesce(nq, 0) as quiet_members, coalesce(nt, 0) + members - coalesce(present, 0) as abstained, coalesce(wm, 0) + coalesce(nq, 0) as voters,
 case when coalesce(wm, 0) + coalesce(nq, 0) >= 2 then coalesce(wm, 0) = 0 or coalesce(nq, 0) = 0 end as unanimous, flip as wstar_flip_at_mps, flop as depth_flip_at_m
from ds join ms using (site) left join pz using (site, day) left join wv using (site, day) left join qv using (site, day) left join fl using (site, day) where coalesce(wm, 0) + coalesce(nq, 0) > 0 or coalesce(nt, 0) + members - coalesce(present, 0) > 0""",
)
def c03_window_agreement(spark, d):
    h = shared_hours(spark, d, only=("profile_id", "hour_index", "valid_at", "day", "local_hour", "before_h", "after_h", "launch_m", "profile_elevation_m", "thermal_velocity_mps", "usable_lift_top_m"))
    covered = _sited(h).select("site", "member", "day").distinct()
    return compare.window_agreement(covered, _windows(h), _sited(findings.quiet_days(h)), benches=_benched(h))


@R.add("c06_height_spread", f"with {VOTES}, bs as (select site, day, member, max(ph) as best from vw where pday = day group by all) select site, day, count(*) as members, {R1.format('(max(best) - min(best))')} as spread_m from bs group by all having count(*) >= 2")
def c06_height_spread(spark, d):
    w = _windows(shared_hours(spark, d))
    return compare.height_spread(w.where(times.local_day(F.col("peak_at"), ZONE) == F.col("day")).withColumn("height_m", F.col("peak_above_launch_m")))


@R.add(
    "c04_timing_envelope",
    f"""with {VOTES}, pm as (select site, day, member, arg_min((sa, cs), sa) as s, arg_max((ea, ce), ea) as e from vw group by all),
tm as (select site, day, case when not s[2] and {DAY_OF.format('s[1]')} = day then epoch_us(s[1]) / 3.6e9 end as sh, case when not e[2] and {DAY_OF.format('e[1]')} = day then epoch_us(e[1]) / 3.6e9 end as eh from pm)
select site, day, case when count(sh) >= 2 then {R1.format('(max(sh) - min(sh))')} end as start_spread_h, case when count(eh) >= 2 then {R1.format('(max(eh) - min(eh))')} end as end_spread_h from tm group by all""",
)
def c04_timing_envelope(spark, d):
    w = _windows(profile_hours(spark, d))
    return compare.timing(w.withColumn("start_day", times.local_day(F.col("start_at"), ZONE)).withColumn("end_day", times.local_day(F.col("end_at"), ZONE)))


@R.add(
    "c02_member_ledger",
    f"""with {VOTES}, {BENCHED}, g as (select profile_id % 50 as site, profile_id // 50 as member, max(valid_at) as reference_time, max(after_h) as step_h, count(*) as n_hours, any_value(profile_elevation_m) as model_elevation_m, any_value(launch_m) as launch_m from hp group by profile_id)
select site, member, reference_time, (epoch_us(max(reference_time) over (partition by site)) - epoch_us(reference_time)) / 3.6e9 as run_age_h, step_h, n_hours, model_elevation_m, launch_m, {R1.format('(model_elevation_m - launch_m)')} as elevation_delta_m,
 case when bn.site is not null then 'terrainMismatch' end as benched, bn.delta_m as benched_delta_m from g left join bn using (site, member)""",
)
def c02_member_ledger(spark, d):
    h = shared_hours(spark, d)
    members = _sited(h.groupBy("profile_id").agg(F.max("valid_at").alias("reference_time"), F.max("after_h").alias("step_h"), F.count("*").alias("n_hours"), F.first("profile_elevation_m").alias("model_elevation_m"), F.first("launch_m").alias("launch_m")))
    return at_utc(compare.member_ledger(members, _benched(h)), "reference_time")


LINES = "(select o_custkey % 20 as site, o_orderpriority as model, date_trunc('month', o_orderdate)::timestamp as reference_time, o_orderdate + (o_orderkey % 5)::int * interval 1 hour as generated_at, o_orderkey as line_no, (o_custkey * 13) % 1200 as elevation_m, o_totalprice as height_m from orders)"


def history_lines(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("site"), F.col("o_orderpriority").alias("model"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("reference_time"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 5).cast("int"))).cast("timestamp_ntz").alias("generated_at"), F.col("o_orderkey").alias("line_no"), (F.col("o_custkey") * 13 % 1200).alias("elevation_m"), F.col("o_totalprice").alias("height_m"))


KEPT = f"kept as (select *, count(*) over (partition by site, model, reference_time) - 1 as superseded from {LINES} l qualify row_number() over (partition by site, model, reference_time order by generated_at desc, line_no desc) = 1)"


@R.add("a25_keep_latest", f"with {KEPT} select site, model, reference_time, generated_at, line_no, superseded from kept")
def a25_keep_latest(spark, d):
    return compare.keep_latest(history_lines(spark, d), ["site", "model", "reference_time"]).select("site", "model", "reference_time", "generated_at", "line_no", "superseded")


@R.add("c13_settled", f"with {KEPT}, n as (select * from kept qualify row_number() over (partition by site, model order by reference_time desc) <= 3) select site, model, count(*) as runs, round(max(height_m) - min(height_m), 6) as spread, count(height_m) >= 3 and max(height_m) - min(height_m) <= 50000 as settled from n group by all")
def c13_settled(spark, d):
    kept = compare.keep_latest(history_lines(spark, d), ["site", "model", "reference_time"])
    return compare.settled(kept, ["site", "model"], "height_m", within=50_000).withColumn("spread", F.round("spread", 6))


@R.add("c14_identity_drift", f"with {KEPT}, n as (select *, lag(elevation_m) over w as was, row_number() over w as k from kept window w as (partition by site, model order by reference_time)) select site, model, reference_time, 'elevation_m' as field, was::double as was, elevation_m::double as now from n where k > 1 and was is distinct from elevation_m")
def c14_identity_drift(spark, d):
    kept = compare.keep_latest(history_lines(spark, d), ["site", "model", "reference_time"])
    return compare.identity_drift(kept, ["site", "model"], ("elevation_m",))


@R.add("t02_t03_newest_runs", f"with {KEPT} select site, model, reference_time, row_number() over (partition by site, model order by reference_time desc)::int as rung, round(height_m - lead(height_m) over (partition by site, model order by reference_time desc), 6) as change_m from kept")
def t02_t03_newest_runs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("site", "model").orderBy(F.col("reference_time").desc())
    kept = compare.keep_latest(history_lines(spark, d), ["site", "model", "reference_time"])
    return kept.select("site", "model", "reference_time", F.row_number().over(w).alias("rung"), F.round(F.col("height_m") - F.lead("height_m").over(w), 6).alias("change_m"))


@R.add("j01_align", f"with {HOURS} select valid_at, count(*) as hours from o group by all having count(distinct model) = 5")
def j01_align(spark, d):
    """Instants at which every model has an hour."""
    h = forecast_hour(spark, d).groupBy("valid_at", "model").agg(F.count("*").alias("hours"))
    return h.groupBy("valid_at").agg(F.count("*").alias("n"), F.sum("hours").alias("hours")).where("n = 5").drop("n")


@R.add(
    "j03_nearest_observation",
    f"""with {HISTORY}, a as (select * from h where seq % 3 = 0), b as (select * from h where seq % 3 <> 0),
m as (select a.seq, arg_min((b.seq, abs(epoch_us(a.observed_at) - epoch_us(b.observed_at)) / 6e7), (abs(epoch_us(a.observed_at) - epoch_us(b.observed_at)), b.seq)) as best from a join b on a.station_id = b.station_id and abs(epoch_us(a.observed_at) - epoch_us(b.observed_at)) <= 14400000000 group by a.seq)
select a.seq, best[1] as r_seq, round(best[2], 6) as offset_minutes from a left join m using (seq)""",
)
def j03_nearest_observation(spark, d):
    h = station_history(spark, d).select("station_id", "seq", "observed_at")
    near = sequences.nearest_join(h.where("seq % 3 = 0"), h.where("seq % 3 != 0"), "station_id", "observed_at", "observed_at", "seq", 4 * 3600)
    return near.select("seq", "r_seq", F.round("offset_minutes", 6).alias("offset_minutes"))


@R.add("j10_direction_spread", f"with {HISTORY}, m as (select station_id, round((atan2(sum(sin(wind_direction_deg * pi() / 180)), sum(cos(wind_direction_deg * pi() / 180))) / (pi() / 180) % 360 + 360) % 360, 3) as deg from h where wind_avg_mps >= 0.5 and wind_direction_deg is not null group by 1) select a.station_id % 10 as site, round(max(180 - abs(abs(a.deg - b.deg) - 180)), 3) as separation_deg from m a join m b on a.station_id % 10 = b.station_id % 10 and a.station_id < b.station_id group by 1")
def j10_direction_spread(spark, d):
    m = station.mean_direction(station_history(spark, d)).select((F.col("station_id") % 10).alias("site"), F.col("station_id").alias("ord"), F.round("mean_direction_deg", 3).alias("deg"))
    return compare.widest_separation(m, "site").select("site", F.round("separation_deg", 3).alias("separation_deg"))


@R.add("j17_u07_merged_window", f"with {HISTORY}, k as (select station_id, date_trunc('hour', observed_at) as hr, min(case when seq % 2 = 0 then 0 else 1 end) as added, arg_max(wind_avg_mps, (seq % 2, seq)) as v from h group by all), e as (select *, max(hr) over (partition by station_id) as last_at from k) select station_id, hr as at, round(v, 6) as value, added = 1 as newly_added from e where hr >= last_at - interval 72 hour")
def j17_u07_merged_window(spark, d):
    from ridgelift.operators import publish

    h = station_history(spark, d).select("station_id", F.date_trunc("hour", "observed_at").cast("timestamp_ntz").alias("at"), "seq", F.col("wind_avg_mps").alias("value"))
    return publish.merged_window(h.where("seq % 2 = 0"), h.where("seq % 2 = 1"), 72).withColumn("value", F.round("value", 6))


@R.add("d03_d04_local_time", f"with {HOURS} select hour_id, strftime((valid_at + (hour_id % 24)::int * interval 1 hour) at time zone 'UTC' at time zone '{ZONE}', '%Y-%m-%dT%H:%M') as local, (date_trunc('day', valid_at) + interval 12 hour) at time zone '{ZONE}' at time zone 'UTC' as noon_at from o")
def d03_d04_local_time(spark, d):
    at = F.col("valid_at").cast("timestamp") + F.make_interval(hours=(F.col("hour_id") % 24).cast("int"))
    day = F.date_format("valid_at", "yyyy-MM-dd")
    return forecast_hour(spark, d).select("hour_id", times.cited(at, ZONE).alias("local"), times.local_instant(day, 12, ZONE).cast("timestamp_ntz").alias("noon_at"))


@R.add("d06_offsets", "with t as (select o_orderkey as k, (case when o_orderkey % 2 = 0 then '+' else '-' end) || lpad((o_orderkey % 20)::varchar, 2, '0') || ':' || lpad((o_orderkey * 7 % 80)::varchar, 2, '0') as s from orders) select k, s, case when (k % 20) <= 14 and (k * 7 % 80) < 60 then (case when k % 2 = 0 then 1 else -1 end) * ((k % 20) * 60 + k * 7 % 80) end::int as minutes from t")
def d06_offsets(spark, d):
    k = F.col("o_orderkey")
    s = F.concat(F.when(k % 2 == 0, "+").otherwise("-"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit(":"), F.lpad((k * 7 % 80).cast("string"), 2, "0"))
    return table(spark, d, "orders").select(k.alias("k"), s.alias("s")).select("k", "s", times.offset_minutes(F.col("s")).cast("int").alias("minutes"))


@R.add("s34_runs_index", f"with {KEPT} select model, max(reference_time) as reference_time, arg_max(generated_at, (reference_time, generated_at)) as generated_at from kept group by model")
def s34_runs_index(spark, d):
    from ridgelift.operators import publish

    return publish.runs_index(compare.keep_latest(history_lines(spark, d), ["site", "model", "reference_time"]))


@R.add("s25_site_set", f"with {KEPT}, m as (select model, max(reference_time) as anchor from kept group by 1), s as (select site, model, max(reference_time) as ref from kept group by all) select model, count(distinct ref) > 1 as syncing, count(*) filter (ref = anchor) as current_sites, count(*) as sites from s join m using (model) group by model")
def s25_site_set(spark, d):
    from ridgelift.operators import publish

    kept = compare.keep_latest(history_lines(spark, d), ["site", "model", "reference_time"])
    return publish.site_set(kept.groupBy("site", "model").agg(F.max("reference_time").alias("reference_time")))


@R.add("s30_history_since", f"with {KEPT} select site, model, reference_time, line_no from kept where reference_time >= timestamp '2000-01-01'")
def s30_history_since(spark, d):
    recent = history_lines(spark, d).where(F.col("reference_time") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return compare.keep_latest(recent, ["site", "model", "reference_time"]).select("site", "model", "reference_time", "line_no")


@R.add("a27_a30_a31_small_statistics", f"with {HISTORY} select station_id, list_sort(list(wind_avg_mps))[count(*) // 2 + 1] as upper_median, arg_min(wind_avg_mps, (abs(wind_avg_mps - 0.9), wind_avg_mps)) as nearest, case when count(*) >= 2 then round(max(wind_avg_mps) - min(wind_avg_mps), 6) end as spread from h group by station_id")
def a27_a30_a31_small_statistics(spark, d):
    from ridgelift.operators.series import at_place

    s, h = F.col("wind_avg_mps"), station_history(spark, d)
    g = h.groupBy("station_id").agg(compare.nearest_to(s, 0.9).alias("nearest"), F.round(compare.spread(s), 6).alias("spread"))
    median = at_place(h, "station_id", "wind_avg_mps", lambda n: F.floor(n / 2) + 1).withColumnRenamed("wind_avg_mps", "upper_median")
    return g.join(median, "station_id", "left").select("station_id", "upper_median", "nearest", "spread")
