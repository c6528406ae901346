"""The batch twins of the live operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ridgelift.sources import live_frames
from ridgelift.sources.projections import HISTORY, station_history, table
from ridgelift.streaming import ingest, live

from .registry import Registry

R = Registry()


@R.add("st09_digests", f"with {HISTORY} select station_id, time_bucket(interval 60 minute, observed_at) as start_at, count(*) as n, round(avg(wind_avg_mps), 6) as mean_mps, round(max(wind_avg_mps), 6) as peak_mps from h group by all")
def st09_digests(spark, d):
    r = live.digests(station_history(spark, d), 60)
    return r.select("station_id", F.col("start_at").cast("timestamp_ntz").alias("start_at"), "n", F.round("mean_mps", 6).alias("mean_mps"), F.round("peak_mps", 6).alias("peak_mps"))


@R.add("st10_sessions", f"with {HISTORY}, g as (select *, case when epoch_us(observed_at) - epoch_us(lag(observed_at) over (partition by station_id order by observed_at)) > 480 * 60000000::bigint then 1 else 0 end as b from h), r as (select *, sum(b) over (partition by station_id order by observed_at rows unbounded preceding) as s from g) select station_id, min(observed_at) as started_at, max(observed_at) as ended_at, count(*) as n, round(max(wind_avg_mps), 6) as peak_mps from r group by station_id, s")
def st10_sessions(spark, d):
    r = live.sessions(station_history(spark, d), 480)
    return r.select("station_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")], "n", F.round("peak_mps", 6).alias("peak_mps"))


@R.add("u06_st02_rolling_window", f"with {HISTORY}, p as (select station_id, observed_at, arg_max(wind_avg_mps, seq) as v from h group by all), m as (select *, max(observed_at) over (partition by station_id) as last_at from p) select station_id, observed_at, round(v, 6) as wind_avg_mps from m where observed_at >= last_at - interval 48 hour")
def u06_st02_rolling_window(spark, d):
    r = live.rolling_window(station_history(spark, d), 48 * 3600)
    return r.select("station_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), F.round("wind_avg_mps", 6).alias("wind_avg_mps"))


def live_events(spark, d):
    """A vendor's events made of station rows: pings, samples, digests with and without step blocks, inits, unknown types and unreadable messages."""
    e = table(spark, d, "events")
    n, speed = F.col("event_id"), F.least(F.col("value") / 20.0, F.lit(140.0))
    said = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ts = F.col("ts").cast("timestamp")
    sample = lambda at, v, deg: F.struct(said(at).alias("ts"), v.alias("sp"), deg.cast("double").alias("dir"))
    samples = F.array(sample(ts, speed, n * 37 % 360), F.when(n < 0, sample(ts, speed, n)), sample(ts - F.expr("interval 3 seconds"), speed / 2, n % 360))
    step = F.struct(speed.alias("wind_avg_1D"), (n % 361).cast("double").alias("wind_dir"), (speed + 1).alias("wind_max"))
    recent = F.struct(said(ts).alias("date_utc"), speed.alias("wind_avg_2D"), (n % 361).cast("double").alias("wind_dir"), (n % 35).cast("double").alias("temperature"), F.lit(900.0).alias("pressure_hpa"))
    minutes = F.when(n % 2 == 0, F.array(F.when(n < 0, step), step)).otherwise(F.array(step, F.when(n < 0, step), step))
    kind = n % 7
    data = (
        F.when(kind.isin(1, 2), F.to_json(F.struct(F.lit("WIND_SAMPLES").alias("type"), samples.alias("samples")), {"ignoreNullFields": "false"}))
        .when(kind == 3, F.to_json(F.struct(F.lit("LAST_DIGEST").alias("type"), recent.alias("recent"))))
        .when(kind == 4, F.to_json(F.struct(F.lit("LAST_DIGEST").alias("type"), recent.alias("recent"), minutes.alias("last_10mn_by_1mn")), {"ignoreNullFields": "false"}))
        .when(kind == 5, F.to_json(F.struct(F.lit("INIT").alias("type"), F.struct(recent.alias("recent"), minutes.alias("last_10mn_by_1mn")).alias("digest"), samples.alias("samples")), {"ignoreNullFields": "false"}))
        .when(n % 14 == 6, '{"type":"NEWS"}')
        .when(kind == 6, '{"type":')
    )
    return e.select(F.col("user_id").alias("station_id"), n.alias("seq"), F.when(kind == 0, "ping").otherwise("message").alias("event"), data.alias("data"), ts.alias("served_at"), F.lit(True).alias("has_temperature"), F.lit(True).alias("has_pressure"), F.lit(False).alias("has_battery"), F.lit(500.0).alias("elevation_m"))


@R.add(
    "st01_st05_live_frames",
    """with f as (select user_id as station_id, event_id as seq, event_id % 7 as k, ts, least(value / 20.0::double, 140.0::double) as v from events where event_id % 14 <> 6),
i as (select station_id, max(seq) as init from f where k = 5 group by all), x as (select f.*, coalesce(seq >= init, false) as since from f left join i using (station_id)),
g as (select station_id, max(seq) as seq, case when count(*) filter (k between 1 and 5) > 0 then 'open' else 'connecting' end as status, case when arg_max(k, seq) filter (k <> 0) = 6 then 'network' end as error, arg_max(ts, seq) filter (k between 3 and 5) as served_at,
 arg_max(v, seq) filter (since and k between 3 and 5) as v, arg_max(seq % 35, seq) filter (since and k between 3 and 5) as t, arg_max(1 + seq % 2, seq) filter (since and k in (4, 5)) as points from x group by station_id),
s as (select station_id, seq, 2 as o, ts as t_at, v as mps from f where k in (1, 2, 5) union all select station_id, seq, 1, ts - interval 3 second, v / 2 from f where k in (1, 2, 5)),
p as (select station_id, t_at, arg_max(mps, (seq, o)) as mps from s group by all), m as (select *, max(t_at) over (partition by station_id) as last_at from p), w as (select station_id, count(*) as n, max(t_at) as newest_at, avg(mps) as mean from m where t_at >= last_at - interval 48 hour group by all)
select station_id, seq, status, error, served_at, round(v, 6) as wind_avg_mps, round(900 * power(1 + 0.0065 * 500 / (t + 273.15), 5.257), 4) is not null as reduced, t::double as temperature_c, points::int as summary_points, coalesce(n, 0)::int as samples, newest_at, round(mean, 9) as mean_mps from g left join w using (station_id)""",
)
def st01_st05_live_frames(spark, d):
    s = live.frame_snapshots(live_frames.frames(live_events(spark, d)), 48 * 3600)
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x["wind_mps"]) / F.nullif(F.size("samples"), F.lit(0))
    return s.select(
        "station_id", "seq", "status", "error", F.col("served_at").cast("timestamp_ntz").alias("served_at"), F.round("reading.wind_avg_mps", 6).alias("wind_avg_mps"), F.col("reading.sea_level_pressure_hpa").isNotNull().alias("reduced"),
        F.col("reading.temperature_c").alias("temperature_c"), F.size(F.try_element_at("summaries", F.lit(1))["points"]).alias("summary_points"), F.size("samples").alias("samples"), F.try_element_at("samples", F.lit(-1))["observed_at"].cast("timestamp_ntz").alias("newest_at"), F.round(mean, 9).alias("mean_mps"),
    )


@R.add(
    "st06_s18_fresh_granules",
    """with e as (select event_id, date_trunc('second', ts) as at_s, max(date_trunc('second', ts)) over () as now from events), p as (select * from e where event_id % 3 = 0 and at_s < now - interval 30 hour), c as (select greatest(max(now) - interval 72 hour, max(at_s) - interval 12 hour) as since from p)
select 'g-' || event_id::varchar || '_s' || strftime(at_s, '%Y%j%H%M%S') || '0.nc' as key, at_s as observed_at from e, c where at_s > since and event_id % 10 <> 7 and not (event_id % 3 = 0 and at_s < now - interval 30 hour)""",
)
def st06_s18_fresh_granules(spark, d):
    """Listing pages of a day's granules each, some of them published already: what the next run reads."""
    e = table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("observed_at"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("observed_at").alias("now"))))  # one row
    key = F.concat(F.lit("g-"), F.col("event_id").cast("string"), F.lit("_s"), F.date_format("observed_at", "yyyyDDDHHmmss"), F.lit("0"), F.when(F.col("event_id") % 10 == 7, ".txt").otherwise(".nc"))
    e = e.withColumn("key", key)
    item = F.concat(F.lit("<Contents><Key>"), F.col("key"), F.lit("</Key></Contents>"))
    pages = e.groupBy(F.date_format("observed_at", "yyyy-DDD").alias("path")).agg(F.array_join(F.collect_list(item), "").alias("body"))
    published = e.where((F.col("event_id") % 3 == 0) & (F.col("observed_at") < F.col("now") - F.expr("interval 30 hours")))
    now = e.agg(F.max("observed_at")).head()[0]
    return ingest.fresh_keys(pages, published, now, dt.timedelta(hours=72), dt.timedelta(hours=12)).select("key", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))
