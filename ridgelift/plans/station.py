"""Station analytics: history views, roses, patterns, runs, summaries and the climatology cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.operators import climatology, station
from ridgelift.sources.projections import HISTORY, PERIOD_MINUTES, station_history

from .registry import Registry

R = Registry()
RAD = "(pi() / 180)"
BLOW = "wind_avg_mps >= 0.5 and wind_direction_deg is not null"
BEARING = "(atan2({s}, {c}) / " + RAD + " % 360 + 360) % 360"
SECTOR16 = "(floor(wind_direction_deg / 22.5 + 0.5)::int % 16)"
BANDS = "(case when wind_avg_mps >= 2 then 1 else 0 end + case when wind_avg_mps >= 5 then 1 else 0 end + case when wind_avg_mps >= 10 then 1 else 0 end)"


@R.add(
    "a13_wind_rose",
    f"""with {HISTORY}, t as (select count(*) as n, count(*) filter ({BLOW}) as blowing from h),
s as (select {SECTOR16} as sector, * from h where {BLOW}),
g as (select sector, count(*) as c, avg(wind_avg_mps) as m, max(wind_gust_mps) as x, count(*) filter ({BANDS} = 0) as b0,
  count(*) filter ({BANDS} = 1) as b1, count(*) filter ({BANDS} = 2) as b2, count(*) filter ({BANDS} = 3) as b3 from s group by sector)
select r.sector::int as sector, r.sector * 22.5::double as bearing_deg, coalesce(c, 0)::bigint as n, round(case when blowing = 0 then 0 else coalesce(c, 0) / blowing::double end, 6) as frequency,
 round(m, 6) as mean_speed_mps, round(x, 6) as max_gust_mps, coalesce(b0, 0)::bigint as band_0, coalesce(b1, 0)::bigint as band_1, coalesce(b2, 0)::bigint as band_2, coalesce(b3, 0)::bigint as band_3,
 t.n as sample_count, round(case when t.n = 0 then 0 else (t.n - blowing) / t.n::double end, 6) as calm_fraction
from range(16) r(sector) left join g using (sector) cross join t""",
)
def a13_wind_rose(spark, d):
    return station.wind_rose(station_history(spark, d), 16, (2.0, 5.0, 10.0))


@R.add(
    "a08_circular_mean",
    f"""with {HISTORY} select station_id, case when count(*) filter ({BLOW}) > 0 then round({BEARING.format(s=f"sum(sin(wind_direction_deg * {RAD})) filter ({BLOW})", c=f"sum(cos(wind_direction_deg * {RAD})) filter ({BLOW})")}, 4) end as mean_direction_deg from h group by station_id""",
)
def a08_circular_mean(spark, d):
    return station.mean_direction(station_history(spark, d)).select("station_id", F.round("mean_direction_deg", 4).alias("mean_direction_deg"))


VECTOR = f"""select {{keys}}, count(*) as n, coalesce(sum(-wind_avg_mps * sin(wind_direction_deg * {RAD})), 0) / count(*) as u, coalesce(sum(-wind_avg_mps * cos(wind_direction_deg * {RAD})), 0) / count(*) as v from h group by {{keys}}"""


@R.add(
    "a10_vector_mean",
    f"""with {HISTORY}, m as ({VECTOR.format(keys='station_id')})
select station_id, round(sqrt(u * u + v * v), 6) as speed_mps, case when sqrt(u * u + v * v) >= 0.5 then round({BEARING.format(s='-u', c='-v')}, 4) end as direction_deg from m""",
)
def a10_vector_mean(spark, d):
    return station.vector_mean(station_history(spark, d)).select("station_id", F.round("speed_mps", 6).alias("speed_mps"), F.round("direction_deg", 4).alias("direction_deg"))


@R.add(
    "a11_period_summary",
    f"""with {HISTORY} select station_id, round(avg(wind_avg_mps), 6) as wind_avg_mps, round(max(wind_gust_mps), 6) as peak_gust_mps,
 arg_min(observed_at, (-wind_gust_mps, observed_at, seq)) filter (wind_gust_mps is not null) as peak_gust_at, round(min(wind_lull_mps), 6) as lowest_lull_mps, max(observed_at) as period_ended_at,
 max(temperature_c) as temperature_high_c, arg_min(observed_at, (-temperature_c, observed_at, seq)) filter (temperature_c is not null) as temperature_high_at,
 min(temperature_c) as temperature_low_c, arg_min(observed_at, (temperature_c, observed_at, seq)) filter (temperature_c is not null) as temperature_low_at,
 round(sum(wind_avg_mps) * {PERIOD_MINUTES} * 60 / 1000, 6) as wind_run_km from h group by station_id""",
)
def a11_period_summary(spark, d):
    r = station.period_summary(station_history(spark, d), PERIOD_MINUTES)
    return r.select(*[F.round(c, 6).alias(c) if c in ("wind_avg_mps", "peak_gust_mps", "lowest_lull_mps", "wind_run_km") else c for c in r.columns])


@R.add(
    "a12_samples_summary",
    f"""with {HISTORY}, s as (select *, max(observed_at) over (partition by station_id) as last_at from h), w as (select * from s where observed_at >= last_at - interval 72 hour)
select station_id, count(*) as n, round(arg_max(wind_avg_mps, (observed_at, seq)), 6) as latest_mps, round(max(wind_avg_mps), 6) as peak_mps, round(avg(wind_avg_mps), 6) as mean_mps,
 round((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 6e7, 6) as span_minutes from w group by station_id""",
)
def a12_samples_summary(spark, d):
    r = station.samples_summary(station.trailing(station_history(spark, d), 72))
    return r.select("station_id", "n", *[F.round(c, 6).alias(c) for c in ("latest_mps", "peak_mps", "mean_mps", "span_minutes")])


@R.add(
    "a15_daily_pattern",
    f"""with {HISTORY}, b as (select *, ((floor(epoch_us(observed_at) / 6e7)::bigint - 480) % 1440 + 1440) % 1440 // 180 as slot from h),
m as ({VECTOR.format(keys='slot').replace('from h', 'from b')})
select (r.slot * 180)::int as start_minute, coalesce(n, 0)::bigint as sample_count, round(coalesce(sqrt(u * u + v * v), 0), 6) as speed_mps, case when sqrt(u * u + v * v) >= 0.5 then round({BEARING.format(s='-u', c='-v')}, 4) end as direction_deg
from range(8) r(slot) left join m using (slot)""",
)
def a15_daily_pattern(spark, d):
    r = station.daily_pattern(station_history(spark, d), 180, -480)
    return r.select("start_minute", "sample_count", F.round("speed_mps", 6).alias("speed_mps"), F.round("direction_deg", 4).alias("direction_deg"))


ARCS = "((wind_direction_deg >= 350 or wind_direction_deg <= 30) or (wind_direction_deg between 150 and 210))"


@R.add(
    "a16_favorable_share",
    f"""with {HISTORY} select station_id, round(count(*) filter ({BLOW} and {ARCS}) / nullif(count(*) filter ({BLOW}), 0)::double, 6) as share from h group by station_id""",
)
def a16_favorable_share(spark, d):
    r = station.favorable_share(station_history(spark, d), ((350.0, 30.0), (150.0, 210.0)))
    return r.select("station_id", F.round("share", 6).alias("share"))


@R.add("p16_p17_arcs", f"with {HISTORY} select seq, {ARCS} as inside, (30 - wind_direction_deg) % 360 + case when (30 - wind_direction_deg) % 360 < 0 then 360 else 0 end as span_to_30 from h where wind_direction_deg is not null")
def p16_p17_arcs(spark, d):
    from ridgelift.functions import wind

    deg = F.col("wind_direction_deg")
    h = station_history(spark, d).where(deg.isNotNull())
    return h.select("seq", (wind.in_arc(deg, 350.0, 30.0) | wind.in_arc(deg, 150.0, 210.0)).alias("inside"), wind.arc_span(deg, F.lit(30.0)).alias("span_to_30"))


@R.add(
    "a17_history_coverage",
    f"""with {HISTORY} select station_id, count(*) filter (observed_at >= timestamp '2024-01-05' and observed_at < timestamp '2024-01-25') as actual_count, {20 * 1440 // PERIOD_MINUTES}::bigint as expected_count,
 round(count(*) filter (observed_at >= timestamp '2024-01-05' and observed_at < timestamp '2024-01-25') / {20 * 1440 // PERIOD_MINUTES}::double, 6) as ratio from h group by station_id""",
)
def a17_history_coverage(spark, d):
    r = station.coverage(station_history(spark, d), PERIOD_MINUTES, "2024-01-05", "2024-01-25")
    return r.select("station_id", "actual_count", "expected_count", F.round("ratio", 6).alias("ratio"))


LAGGED = f"""select *, lag(observed_at) over (partition by station_id order by observed_at, seq) as previous_at from h"""
LIMIT = PERIOD_MINUTES * 60 * 2.5


@R.add("w04_history_gaps", f"with {HISTORY}, g as ({LAGGED}) select station_id, previous_at as from_at, observed_at as to_at from g where epoch_us(observed_at) - epoch_us(previous_at) > {LIMIT} * 1000000")
def w04_history_gaps(spark, d):
    return station.gaps(station_history(spark, d), PERIOD_MINUTES)


RUNS = f"""r as (select *, sum(case when epoch_us(observed_at) - epoch_us(previous_at) > {LIMIT} * 1000000 then 1 else 0 end) over (partition by station_id order by observed_at, seq rows unbounded preceding) as run_id from g)"""


@R.add("w05_gap_runs", f"with {HISTORY}, g as ({LAGGED}), {RUNS} select station_id, run_id::bigint as run_id, min(observed_at) as started_at, max(observed_at) as ended_at, count(*) as n, round(sum(wind_avg_mps), 6) as wind_sum from r group by all")
def w05_gap_runs(spark, d):
    r = station.runs(station_history(spark, d), PERIOD_MINUTES)
    return r.groupBy("station_id", "run_id").agg(F.min("observed_at").alias("started_at"), F.max("observed_at").alias("ended_at"), F.count("*").alias("n"), F.round(F.sum("wind_avg_mps"), 6).alias("wind_sum"))


@R.add(
    "w06_trend_runs",
    f"""with {HISTORY}, g as ({LAGGED}), r as (select *, sum(case when temperature_c is null or epoch_us(observed_at) - epoch_us(previous_at) > {LIMIT} * 1000000 then 1 else 0 end) over (partition by station_id order by observed_at, seq rows unbounded preceding) as run_id from g)
select station_id, min(observed_at) as started_at, count(*) as n, round(sum(temperature_c), 6) as total from r where temperature_c is not null group by station_id, run_id""",
)
def w06_trend_runs(spark, d):
    return station.trend_runs(station_history(spark, d), "temperature_c", PERIOD_MINUTES).groupBy("station_id", "run_id").agg(F.min("observed_at").alias("started_at"), F.count("*").alias("n"), F.round(F.sum("temperature_c"), 6).alias("total")).drop("run_id")


@R.add(
    "w07_band_strips",
    f"""with {HISTORY}, g as ({LAGGED}), r as (select *, sum(case when wind_gust_mps is null or wind_lull_mps is null or epoch_us(observed_at) - epoch_us(previous_at) > {LIMIT} * 1000000 then 1 else 0 end) over (partition by station_id order by observed_at, seq rows unbounded preceding) as run_id from g)
select station_id, min(observed_at) as started_at, count(*) as n, round(max(wind_gust_mps), 6) as top, round(min(wind_lull_mps), 6) as bottom from r where wind_gust_mps is not null and wind_lull_mps is not null group by station_id, run_id""",
)
def w07_band_strips(spark, d):
    r = station.band_strips(station_history(spark, d), PERIOD_MINUTES)
    return r.groupBy("station_id", "run_id").agg(F.min("observed_at").alias("started_at"), F.count("*").alias("n"), F.round(F.max("wind_gust_mps"), 6).alias("top"), F.round(F.min("wind_lull_mps"), 6).alias("bottom")).drop("run_id")


@R.add(
    "w16_w17_pressure_tendency",
    f"""with {HISTORY}, c as (select *, max(observed_at) over (partition by station_id) as last_at from h where sea_level_pressure_hpa is not null),
r as (select station_id, arg_max(sea_level_pressure_hpa, (observed_at, seq)) as last_p, max(last_at) as last_at,
 arg_min((observed_at, sea_level_pressure_hpa), (abs(epoch_us(observed_at) - (epoch_us(last_at) - 43200000000)), observed_at, seq)) as ref from c group by station_id),
x as (select station_id, case when epoch_us(last_at) - epoch_us(ref[1]) >= 43200000000 * 0.6 then last_p - ref[2] end as delta from r)
select station_id, delta as delta_hpa, case when delta >= 1.5 then 'rising' when delta <= -1.5 then 'falling' when delta is not null then 'steady' end as tendency from x""",
)
def w16_w17_pressure_tendency(spark, d):
    return station.pressure_tendency(station_history(spark, d), 12)


@R.add(
    "w18_thin_vanes",
    f"""with {HISTORY}, n as (select *, row_number() over (partition by station_id order by observed_at, seq) - 1 as i, greatest(1, floor(count(*) over (partition by station_id) / 12.0::double + 0.5))::bigint as step from h)
select station_id, i // step as vane, round(avg(wind_avg_mps), 6) as wind_avg_mps, min(i)::bigint as start_index, round((epoch_us(min(observed_at)) + (epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 2) / 1e6, 3) as mid_s from n group by station_id, i // step""",
)
def w18_thin_vanes(spark, d):
    r = station.thin_vanes(station_history(spark, d), 12)
    return r.select("station_id", "vane", F.round("wind_avg_mps", 6).alias("wind_avg_mps"), "start_index", F.round("mid_s", 3).alias("mid_s"))


@R.add(
    "w19_latest_sensor_value",
    f"""with {HISTORY}, s as (select *, max(observed_at) over (partition by station_id) as last_at from h)
select station_id, arg_max(temperature_c, (observed_at, seq)) filter (temperature_c is not null and observed_at >= last_at - interval 900 minute) as temperature_c from s group by station_id""",
)
def w19_latest_sensor_value(spark, d):
    return station.latest_value(station_history(spark, d), "temperature_c", 900)


@R.add("p12_p13_filters", f"with {HISTORY}, x as (select *, ((floor(epoch_us(observed_at) / 6e7)::bigint - 480) % 1440 + 1440) % 1440 as minute from h) select seq from x where month(observed_at - interval 480 minute) in (12, 1, 2) and (minute >= 1320 or minute < 300)")
def p12_p13_filters(spark, d):
    h = station_history(spark, d)
    return h.where(station.in_months(F.col("observed_at"), station.SEASONS["winter"], -480) & station.in_time_of_day(F.col("observed_at"), 1320, 300, -480)).select("seq")


@R.add("p14_trailing_window", f"with {HISTORY}, s as (select *, max(observed_at) over (partition by station_id) as last_at from h) select seq from s where observed_at >= last_at - interval 24 hour")
def p14_trailing_window(spark, d):
    return station.trailing(station_history(spark, d), 24).select("seq")


@R.add(
    "j11_compare_window",
    f"""with {HISTORY}, s as (select *, max(observed_at) over (partition by station_id) as last_at from h),
k as (select station_id, any_value(last_at) as last_at, min(observed_at) as first_at, count(*) as n, min(observed_at) filter (observed_at >= last_at - interval 24 hour) as shown_at, count(*) filter (observed_at >= last_at - interval 24 hour) as now_n from s group by station_id),
m as (select k.station_id, any_value(now_n) as now_n, count(h.seq) as c, any_value(epoch_us(shown_at)) - 604800000000 as a, any_value(epoch_us(last_at)) - 604800000000 as b, epoch_us(min(observed_at)) as ma, epoch_us(max(observed_at)) as mb, any_value(case when n > 1 then (epoch_us(last_at) - epoch_us(first_at)) / (n - 1)::double * 2.5 else 0 end) as tol
 from k left join h on h.station_id = k.station_id and epoch_us(h.observed_at) between epoch_us(shown_at) - 604800000000 and epoch_us(last_at) - 604800000000 group by k.station_id)
select station_id, now_n, case when c > 0 and ma - a <= tol and b - mb <= tol then c end as then_n from m""",
)
def j11_compare_window(spark, d):
    return station.compare_window(station_history(spark, d), hours=24, days_back=7)


@R.add("m31_m32_r38_words", f"with {HISTORY} select seq, case when wind_direction_deg is not null then (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[{SECTOR16} + 1] end as compass, round(wind_avg_mps * 3.6, 6) as kmh, round(wind_avg_mps * 3600 / 1852, 6) as knots, greatest(0, floor(wind_avg_mps * 3.6 / 5 + 0.5)::int) * 5 as barb_kmh, greatest(0, floor(wind_avg_mps * 3.6 / 5 + 0.5)::int) // 10 as pennants from h")
def m31_m32_r38_words(spark, d):
    from ridgelift.functions import wind

    s = F.col("wind_avg_mps")
    rounded, pennants, _, _ = wind.barbs(s * 3.6)
    return station_history(spark, d).select("seq", wind.compass(F.col("wind_direction_deg")).alias("compass"), F.round(s * 3.6, 6).alias("kmh"), F.round(s * 3600 / 1852, 6).alias("knots"), rounded.alias("barb_kmh"), pennants.alias("pennants"))


CUBE = f"""k as (select *, observed_at - interval 480 minute as local_at from h),
cells as (select month(local_at) as month, (hour(local_at) * 60 + minute(local_at)) // 360 as slot, case when {BLOW} then {SECTOR16} end as sector, count(*) as n,
 round(sum(case when {BLOW} then -wind_avg_mps * sin(wind_direction_deg * {RAD}) end), 6)::decimal(28, 6) as u_sum, round(sum(case when {BLOW} then -wind_avg_mps * cos(wind_direction_deg * {RAD}) end), 6)::decimal(28, 6) as v_sum, round(sum(case when {BLOW} then wind_avg_mps end), 6)::decimal(28, 6) as speed_sum, max(case when {BLOW} then wind_gust_mps end) as max_gust from k group by all)"""


@R.add("a18_a19_climatology_cells", f"with {HISTORY}, {CUBE} select month::int as month, slot::int as slot, sector::int as sector, n, u_sum::double as u_sum, v_sum::double as v_sum, speed_sum::double as speed_sum, round(max_gust, 6) as max_gust from cells")
def a18_a19_climatology_cells(spark, d):
    r = climatology.fold(station_history(spark, d), 16, 360, -480)
    return r.select("month", "slot", "sector", "n", *[F.col(c).cast("double").alias(c) for c in ("u_sum", "v_sum", "speed_sum")], F.round("max_gust", 6).alias("max_gust"))


@R.add("a20_climatology_rose", f"with {HISTORY}, {CUBE}, t as (select sum(n) as total, sum(n) filter (sector is not null) as blowing from cells where month in (1, 2)), g as (select sector, sum(n) as c, sum(speed_sum) as s, max(max_gust) as x from cells where sector is not null and month in (1, 2) group by sector) select r.sector::int as sector, coalesce(c, 0)::bigint as n, round(case when coalesce(blowing, 0) = 0 then 0 else coalesce(c, 0) / blowing::double end, 6) as frequency, s::double / c as mean_speed_mps, round(x, 6) as max_gust_mps from range(16) r(sector) left join g using (sector) cross join t")
def a20_climatology_rose(spark, d):
    r = climatology.rose(climatology.fold(station_history(spark, d), 16, 360, -480), 16, months=(1, 2))
    return r.select("sector", "n", F.round("frequency", 6).alias("frequency"), "mean_speed_mps", F.round("max_gust_mps", 6).alias("max_gust_mps"))  # the mean is a quotient of exact sums


@R.add("a21_climatology_pattern", f"with {HISTORY}, {CUBE}, m as (select slot, sum(n)::bigint as n, coalesce(sum(u_sum), 0)::double / sum(n) as u, coalesce(sum(v_sum), 0)::double / sum(n) as v from cells group by slot) select (r.slot * 360)::int as start_minute, coalesce(n, 0)::bigint as sample_count, round(coalesce(sqrt(u * u + v * v), 0), 6) as speed_mps, case when sqrt(u * u + v * v) >= 0.5 then round({BEARING.format(s='-u', c='-v')}, 4) end as direction_deg from range(4) r(slot) left join m using (slot)")
def a21_climatology_pattern(spark, d):
    r = climatology.pattern(climatology.fold(station_history(spark, d), 16, 360, -480), 360)
    return r.select("start_minute", "sample_count", F.round("speed_mps", 6).alias("speed_mps"), F.round("direction_deg", 4).alias("direction_deg"))


@R.add("a22_climatology_coverage", f"with {HISTORY}, k as (select *, observed_at - interval 480 minute as local_at from h) select year(local_at)::int as year, count(distinct (month(local_at), day(local_at), (hour(local_at) * 60 + minute(local_at)) // 360)) as covered_slots, count(*) as n from k group by 1")
def a22_climatology_coverage(spark, d):
    return climatology.covered_slots(station_history(spark, d), 360, -480)


@R.add(
    "a22_coverage_ledger",
    f"""with {HISTORY}, k as (select year(observed_at - interval 480 minute) as y, month(observed_at - interval 480 minute) as month, (hour(observed_at - interval 480 minute) * 60 + minute(observed_at - interval 480 minute)) // 180 as slot from h),
g as (select y, month, slot, count(*) as n, day(last_day(make_date(y, month, 1))) * 180 / {PERIOD_MINUTES}::double as e from k group by all)
select month::int as month, slot::int as slot, count(*) as years, sum(n)::bigint as n, sum(e) as expected_count, round(case when count(*) = (select count(distinct y) from g) then sum(n) / sum(e) end, 6) as ratio from g group by month, slot""",
)
def a22_coverage_ledger(spark, d):
    r = climatology.coverage_ledger(station_history(spark, d), 180, -480, PERIOD_MINUTES)
    return r.withColumn("ratio", F.round("ratio", 6))


@R.add("a24_year_cubes", f"with {HISTORY}, {CUBE.replace('select month(local_at)', 'select year(local_at) as year, month(local_at)')} select year::int as year, month::int as month, slot::int as slot, sector::int as sector, n, u_sum::double as u_sum, v_sum::double as v_sum, speed_sum::double as speed_sum, round(max_gust, 6) as max_gust from cells")
def a24_year_cubes(spark, d):
    r = climatology.year_cubes(station_history(spark, d), 16, 360, -480)
    return r.select("year", "month", "slot", "sector", "n", *[F.col(c).cast("double").alias(c) for c in ("u_sum", "v_sum", "speed_sum")], F.round("max_gust", 6).alias("max_gust"))


@R.add("a23_climatology_favorable", f"with {HISTORY}, {CUBE} select round(sum(n) filter (sector * 22.5 >= 350 or sector * 22.5 <= 30) / nullif(sum(n) filter (sector is not null), 0)::double, 6) as share from cells")
def a23_climatology_favorable(spark, d):
    return climatology.favorable_share(climatology.fold(station_history(spark, d), 16, 360, -480), 16, ((350.0, 30.0),)).select(F.round("share", 6).alias("share"))
