"""Queries over series of forecast steps and station values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgelift.operators import findings, series
from ridgelift.sources.projections import HISTORY, HOURS, forecast_hour, station_history, table

from .findings import PROFILE, R1, R2, at_utc, profile_hours
from .registry import Registry

R = Registry()


@R.add(
    "w03_smooth",
    f"with {HISTORY}, x as (select station_id, date_trunc('hour', observed_at) as hr, arg_max(wind_avg_mps, seq) as v from h group by all), y as (select *, lag(v) over w as p, lead(v) over w as n, lag(hr) over w as ph, lead(hr) over w as nh from x window w as (partition by station_id order by hr)) select station_id, hr as at, round(case when hr - ph = interval 1 hour and nh - hr = interval 1 hour then (p + 2 * v + n) / 4 else v end, 6) as v from y",
)
def w03_smooth(spark, d):
    x = station_history(spark, d).groupBy("station_id", F.date_trunc("hour", "observed_at").cast("timestamp_ntz").alias("at")).agg(F.max_by("wind_avg_mps", "seq").alias("v"))
    return x.select("station_id", "at", F.round(series.smooth(x, ["station_id"], ["at"], "at", "v"), 6).alias("v"))


STEPS = f"{HOURS}, st as (select *, row_number() over (partition by site_id order by valid_at, hour_id) as k from o)"


def _steps(spark, d):
    return forecast_hour(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("site_id").orderBy("valid_at", "hour_id")))


@R.add("w12_deaverage", f"with {STEPS} select hour_id, case when floor((3 * k - 3) / 6.0) * 6 = 3 * k - 3 then latent_heat_flux_wm2 else 2 * latent_heat_flux_wm2 - lag(latent_heat_flux_wm2) over (partition by site_id order by k) end as averaged, case when floor((3 * k - 3) / 6.0) * 6 = 3 * k - 3 then latent_heat_flux_wm2 else latent_heat_flux_wm2 - lag(latent_heat_flux_wm2) over (partition by site_id order by k) end as summed from st")
def w12_deaverage(spark, d):
    v, w = F.col("latent_heat_flux_wm2"), Window.partitionBy("site_id").orderBy("k")
    x = _steps(spark, d).withColumn("_b", F.lag(v).over(w))
    h = F.col("k") * 3
    return x.select("hour_id", series.three_hourly(v, F.col("_b"), h, True).alias("averaged"), series.three_hourly(v, F.col("_b"), h, False).alias("summed"))


@R.add("w14_rate", f"with {STEPS}, t as (select *, 3 * k + k % 2 as fh from st) select hour_id, round(greatest(0, latent_heat_flux_wm2 - coalesce(lag(latent_heat_flux_wm2) over w, 0)) / (fh - coalesce(lag(fh) over w, 0))::double, 6) as rate from t window w as (partition by site_id order by k)")
def w14_rate(spark, d):
    w = Window.partitionBy("site_id").orderBy("k")
    x = _steps(spark, d).withColumn("fh", F.col("k") * 3 + F.col("k") % 2)
    v = F.col("latent_heat_flux_wm2")
    return x.select("hour_id", F.round(series.rate(v, F.lag(v).over(w), F.col("fh"), F.lag("fh").over(w)), 6).alias("rate"))


@R.add("a28_a32_quantiles", f"with {HISTORY} select station_id, round(100.0 * (count(*) filter (temperature_c < 10) + 0.5 * count(*) filter (temperature_c = 10)) / count(temperature_c), 6) as rank_of_10, (list_sort(list(wind_avg_mps)))[least(count(*), floor(0.9 * count(*)) + 1)::int] as p90 from h group by station_id")
def a28_a32_quantiles(spark, d):
    h = station_history(spark, d)
    g = h.groupBy("station_id").agg(F.round(series.percentile_rank(F.col("temperature_c"), 10.0), 6).alias("rank_of_10"))
    p90 = series.at_place(h, "station_id", "wind_avg_mps", lambda n: F.least(n, F.floor(n * 0.9) + 1)).withColumnRenamed("wind_avg_mps", "p90")
    return g.join(p90, "station_id", "left").select("station_id", "rank_of_10", "p90")


@R.add("a29_class_shares", f"with {HISTORY}, c as (select station_id, seq % 7 as code, count(*) as n from h where seq % 7 <> 0 group by all), s as (select *, n / sum(n) over (partition by station_id)::double as share, row_number() over (partition by station_id order by n desc, code) as rank from c) select station_id, code, round(share, 6) as share, rank::int as rank from s where share >= 0.0005")
def a29_class_shares(spark, d):
    cells = station_history(spark, d).select("station_id", (F.col("seq") % 7).alias("code"))
    return series.class_shares(cells, "station_id", "code").withColumn("share", F.round("share", 6))


@R.add("p06_display_hours", f"with {PROFILE}, di as (select profile_id, day from hp where local_hour between 7 and 21 group by all having count(*) >= 2), so as (select distinct profile_id from di) select hour_id from hp left join di using (profile_id, day) left join so using (profile_id) where (local_hour between 7 and 21 and exists (select 1 from di d2 where d2.profile_id = hp.profile_id and d2.day = hp.day)) or not exists (select 1 from so s2 where s2.profile_id = hp.profile_id)")
def p06_display_hours(spark, d):
    return series.display_hours(profile_hours(spark, d), least=2).select("hour_id")


@R.add("t09_archive_period", "select o_orderkey as k, case when m / 1.0 <= 500 then 1 when m / 5.0 <= 500 then 5 when m / 15.0 <= 500 then 15 when m / 60.0 <= 500 then 60 else 180 end as period from (select o_orderkey, o_orderkey * 17 % 100000 as m from orders) t")
def t09_archive_period(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), series.archive_period(F.col("o_orderkey") * 17 % 100_000, (1, 5, 15, 60, 180)).alias("period"))


BAND = "bl as (select hp.*, mb.bw, mb.bz from hp left join (select hp.hour_id, max(l.wind_speed_mps) as bw, arg_min(l.height_m, (-l.wind_speed_mps, l.height_m)) as bz from hp join l using (hour_id) join o using (hour_id) where l.height_m > o.model_elevation_m + 20 and l.height_m between hp.launch_m - 200 and hp.lift_top + 200 group by hp.hour_id) mb using (hour_id))"


@R.add(
    "f08_band_wind",
    f"""with {PROFILE}, {BAND}, pk as (select profile_id, day, max(bw) as mw, arg_min((i, valid_at, bz), (-bw, i)) filter (bw is not null) as p from bl group by all having max(bw) is not null),
jn as (select bl.*, mw, p, coalesce(bw >= mw * 0.8, false) as on_ from bl join pk using (profile_id, day)), cg as (select *, case when on_ <> lag(on_) over (partition by profile_id, day order by i) then 1 else 0 end as ch from jn),
rn as (select *, sum(ch) over (partition by profile_id, day order by i rows unbounded preceding) as run from cg), ls as (select profile_id, day, run, sum(after_h) as persistence_h from rn group by all having bool_or(i = p[1]))
select profile_id, day, {R2.format('mw')} as wind_mps, {R1.format('p[3]')} as height_m, p[2] as at, persistence_h from pk join ls using (profile_id, day)""",
)
def f08_band_wind(spark, d):
    return at_utc(series.band_wind(profile_hours(spark, d)), "at")


@R.add(
    "f10_band_direction",
    f"""with {PROFILE}, bv as (select wh.profile_id, wh.window_id, avg(-l.wind_speed_mps * sin(l.wind_direction_deg * pi() / 180)) as u, avg(-l.wind_speed_mps * cos(l.wind_direction_deg * pi() / 180)) as v, count(*) as samples
  from wh join l using (hour_id) join o using (hour_id) where l.height_m > o.model_elevation_m + 20 and l.height_m between wh.launch_m and wh.lift_top group by all)
select profile_id, window_id::bigint as window_id, {R2.format('sqrt(u * u + v * v)')} as speed_mps, case when sqrt(u * u + v * v) >= 1 then floor(round((atan2(-u, -v) / (pi() / 180) % 360 + 360) % 360, 6) + 0.5) end as direction_deg, samples from bv""",
)
def f10_band_direction(spark, d):
    return series.window_band_direction(findings.window_hours(profile_hours(spark, d)))
