"""Geometry, rasters, hours of documents, nights, catalogues and live frames over projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.functions import geometry
from ridgelift.operators import derive, documents, hours, nights, parcel, raster, station, vertical
from ridgelift.sources.projections import HISTORY, LEVELS, MEMBERS, forecast_hour, forecast_level, member_value, station_history, table
from ridgelift.streaming import live

from .findings import PROFILE, ZONE, at_utc, profile_hours
from .registry import Registry

R = Registry()
RAD = "pi() / 180"


def _r(c, name, digits=6):
    return F.round(c, digits).alias(name)


def places(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), (30 + (k * 7 % 4000) / 100.0).alias("lat"), (-140 + (k * 13 % 8000) / 100.0).alias("lon"), ((k % 41 - 20) / 2.0).alias("u"), ((k * 3 % 37 - 18) / 2.0).alias("v"))


PLACES = "pl as (select o_orderkey as k, 30 + (o_orderkey * 7 % 4000) / 100.0::double as lat, -140 + (o_orderkey * 13 % 8000) / 100.0::double as lon, (o_orderkey % 41 - 20) / 2.0::double as u, (o_orderkey * 3 % 37 - 18) / 2.0::double as v from orders)"


@R.add("m03_wind_from_uv", f"with {PLACES} select k, round(sqrt(u * u + v * v), 6) as speed_mps, round((atan2(-u, -v) * (180 / pi()) % 360 + 360) % 360, 4) % 360 as direction_deg from pl where u <> 0 or v <> 0")
def m03_wind_from_uv(spark, d):
    speed, deg = geometry.wind_from_uv(F.col("u"), F.col("v"))
    return places(spark, d).where("u != 0 or v != 0").select("k", _r(speed, "speed_mps"), F.pmod(F.round(deg, 4), F.lit(360.0)).alias("direction_deg"))


ROTATED = f"""{PLACES}, ru as (select *, cos(lat * {RAD}) * cos(lon * {RAD}) as px, cos(lat * {RAD}) * sin(lon * {RAD}) as py, sin(lat * {RAD}) as pz, 245.305142 * {RAD} as za, (90 - 36.08852) * {RAD} as ya from pl),
rr as (select *, (px * cos(za) + py * sin(za)) * cos(ya) + pz * sin(ya) as gx, -px * sin(za) + py * cos(za) as gy, -(px * cos(za) + py * sin(za)) * sin(ya) + pz * cos(ya) as gz from ru),
rl as (select *, asin(greatest(-1, least(1, gz))) as rlat, atan2(gy, gx) as rlon from rr),
rw as (select *, -u * sin(rlon) - v * sin(rlat) * cos(rlon) as wx, u * cos(rlon) - v * sin(rlat) * sin(rlon) as wy, v * cos(rlat) as wz from rl),
rb as (select *, (wx * cos(ya) - wz * sin(ya)) * cos(za) - wy * sin(za) as tx, (wx * cos(ya) - wz * sin(ya)) * sin(za) + wy * cos(za) as ty, wx * sin(ya) + wz * cos(ya) as tz from rw)"""


@R.add(
    "m06_m08_rotated_grid",
    f"""with {ROTATED} select k, round(rlat / ({RAD}), 6) as grid_lat, round(rlon / ({RAD}), 6) as grid_lon, round(lat, 6) as lat, round(lon, 6) as lon, round(-tx * sin(lon * {RAD}) + ty * cos(lon * {RAD}), 6) as u_true,
 round(-tx * sin(lat * {RAD}) * cos(lon * {RAD}) - ty * sin(lat * {RAD}) * sin(lon * {RAD}) + tz * cos(lat * {RAD}), 6) as v_true from rb""",
)
def m06_m08_rotated_grid(spark, d):
    pole = (-36.08852, 245.305142)
    x = places(spark, d)
    glat, glon = geometry.to_rotated(F.col("lat"), F.col("lon"), *pole)
    u, v = geometry.rotated_wind(F.col("u"), F.col("v"), F.col("lat"), F.col("lon"), *pole)
    x = x.select("k", glat.alias("grid_lat"), glon.alias("grid_lon"), u.alias("u_true"), v.alias("v_true"))
    lat, lon = geometry.from_rotated(F.col("grid_lat"), F.col("grid_lon"), *pole)  # there and back
    return x.select("k", _r("grid_lat", "grid_lat"), _r("grid_lon", "grid_lon"), _r(lat, "lat"), _r(lon, "lon"), _r("u_true", "u_true"), _r("v_true", "v_true"))


CONE = geometry.cone(38.5, 38.5)


@R.add("m07_cone_wind", f"with {PLACES}, an as (select *, {CONE!r}::double * ((((lon + 97.5 + 180) % 360 + 360) % 360) - 180) * {RAD} as a from pl) select k, round(a / ({RAD}), 6) as rotation_deg, round(u * cos(a) + v * sin(a), 6) as u_true, round(-u * sin(a) + v * cos(a), 6) as v_true from an")
def m07_cone_wind(spark, d):
    u, v = geometry.cone_wind(F.col("u"), F.col("v"), F.col("lon"), -97.5, CONE)
    return places(spark, d).select("k", _r(geometry.cone_rotation(F.col("lon"), -97.5, CONE), "rotation_deg"), _r(u, "u_true"), _r(v, "v_true"))


@R.add(
    "m41_j14_scan_angles",
    f"""with {PLACES}, c as (select *, 6356752.31414::double as b, 6378137.0::double as a, 35786023.0::double + 6378137.0::double as h, lon * {RAD} - (-137.0) * {RAD} as dl from pl), g as (select *, atan(tan(lat * {RAD}) * (b / a) * (b / a)) as gl from c),
r as (select *, b / sqrt(1 - cos(gl) * cos(gl) * (1 - (b / a) * (b / a))) as rc from g), s as (select *, h - rc * cos(gl) * cos(dl) as sx, -rc * cos(gl) * sin(dl) as sy, rc * sin(gl) as sz from r),
f as (select k, case when h * (h - sx) >= sy * sy + sz * sz / ((b / a) * (b / a)) then asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) end as x, case when h * (h - sx) >= sy * sy + sz * sz / ((b / a) * (b / a)) then atan(sz / sx) end as y from s),
n as (select k, arg_min(i, (abs(-0.152 + i * 0.004 - x), i)) as i, min(abs(-0.152 + i * 0.004 - x)) as far from f, range(77) t(i) where x is not null group by k)
select f.k, round(x, 9) as x_rad, round(y, 9) as y_rad, case when far <= 0.00199 then i::int end as column_index from f left join n using (k)""",
)
def m41_j14_scan_angles(spark, d):
    x, y = geometry.scan_angles(F.col("lat"), F.col("lon"), -137.0, 35786023.0, 6378137.0, 6356752.31414)
    axis = F.transform(F.sequence(F.lit(0), F.lit(76)), lambda i: F.lit(-0.152) + i * 0.004)
    return places(spark, d).select("k", x.alias("x"), y.alias("y")).select("k", _r("x", "x_rad", 9), _r("y", "y_rad", 9), geometry.nearest_index(axis, F.col("x"), 0.00199).alias("column_index"))


@R.add("d13_tiles", f"with {PLACES} select k, (case when floor(lat) >= 0 then 'N' else 'S' end) || lpad(abs(floor(lat))::int::varchar, 2, '0') || (case when floor(lon) >= 0 then 'E' else 'W' end) || lpad(abs(floor(lon))::int::varchar, 3, '0') as tile from pl")
def d13_tiles(spark, d):
    return places(spark, d).select("k", F.concat(geometry.tile(F.col("lat"), "N", "S", 2), geometry.tile(F.col("lon"), "E", "W", 3)).alias("tile"))


def cells(spark, d):
    """A raster of 40 columns; every 97th cell is masked."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), F.when(k % 97 != 0, F.col("p_retailprice") + k % 13 * 7).alias("z"))


CELLS = "ce as (select p_partkey // 40 as row, p_partkey % 40 as col, case when p_partkey % 97 <> 0 then p_retailprice + p_partkey % 13 * 7 end as z from part)"


@R.add(
    "m36_slopes",
    f"""with {CELLS}, n as (select m.row, m.col, count(*) as n, max(case when o.row = m.row - 1 and o.col = m.col - 1 then o.z end) as a, max(case when o.row = m.row - 1 and o.col = m.col then o.z end) as b, max(case when o.row = m.row - 1 and o.col = m.col + 1 then o.z end) as c,
 max(case when o.row = m.row and o.col = m.col - 1 then o.z end) as d, max(case when o.row = m.row and o.col = m.col + 1 then o.z end) as f, max(case when o.row = m.row + 1 and o.col = m.col - 1 then o.z end) as g, max(case when o.row = m.row + 1 and o.col = m.col then o.z end) as h, max(case when o.row = m.row + 1 and o.col = m.col + 1 then o.z end) as i
 from ce m join ce o on abs(o.row - m.row) <= 1 and abs(o.col - m.col) <= 1 where m.z is not null and o.z is not null group by m.row, m.col),
e as (select row, col, (c + 2 * f + i - (a + 2 * d + g)) / 240 as east, (a + 2 * b + c - (g + 2 * h + i)) / 240 as north from n where n = 9)
select row::bigint as row, col::bigint as col, round(atan(sqrt(east * east + north * north)) / ({RAD}), 6) as slope_deg, round((atan2(-east, -north) / ({RAD}) + 360) % 360, 5) as aspect_deg from e""",
)
def m36_slopes(spark, d):
    return raster.slopes(cells(spark, d), 30.0, 30.0).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), _r("slope_deg", "slope_deg"), _r("aspect_deg", "aspect_deg", 5))


def points(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("point_id"), (50.0 - (k * 11 % 60) / 20.0).alias("latitude"), (-125.0 + (k * 7 % 45) / 10.0).alias("longitude"))


POINTS = "pt as (select s_suppkey as point_id, 50.0 - (s_suppkey * 11 % 60) / 20.0::double as latitude, -125.0 + (s_suppkey * 7 % 45) / 10.0::double as longitude from supplier)"


@R.add(
    "m37_bilinear",
    f"""with {CELLS}, {POINTS}, f as (select *, (longitude + 125.0) / 0.1::double as fx, (latitude - 50.0) / -0.1::double as fy from pt), q as (select point_id, any_value(fx - floor(fx)) as tx, any_value(fy - floor(fy)) as ty, count(z) as n, max(case when row = floor(fy) and col = floor(fx) then z end) as a, max(case when row = floor(fy) and col = floor(fx) + 1 then z end) as b,
 max(case when row = floor(fy) + 1 and col = floor(fx) then z end) as c, max(case when row = floor(fy) + 1 and col = floor(fx) + 1 then z end) as e from f join ce on row between floor(fy) and floor(fy) + 1 and col between floor(fx) and floor(fx) + 1 group by point_id)
select point_id, case when n = 4 then round(a * (1 - tx) * (1 - ty) + b * tx * (1 - ty) + c * (1 - tx) * ty + e * tx * ty, 5) end as z from pt left join q using (point_id)""",
)
def m37_bilinear(spark, d):
    return raster.samples(cells(spark, d), points(spark, d), 50.0, -0.1, -125.0, 0.1).select("point_id", _r("z", "z", 5))


@R.add(
    "m38_discs",
    f"""with {CELLS}, {POINTS}, m as (select point_id, latitude, longitude, z as own from pt join ce on row = round((latitude - 50.0) / -0.1::double) and col = round((longitude + 125.0) / 0.1::double)),
x as (select point_id, own, z from m join ce on z is not null and pow((-125.0 + col * 0.1::double - longitude) * 111320.0 * cos(latitude * {RAD}), 2) + pow((50.0 - row * 0.1::double - latitude) * 111132.0, 2) <= pow(25000.0, 2))
select point_id as centre_id, count(*) as cells, round(avg(z), 5) as mean_m, round(100.0 * (count(*) filter (z < own) + 0.5 * count(*) filter (z = own)) / count(*)::double, 6) as below_pct from x group by point_id""",
)
def m38_discs(spark, d):
    r = raster.disc_statistics(cells(spark, d), points(spark, d).withColumnRenamed("point_id", "centre_id"), 25_000.0, 50.0, -0.1, -125.0, 0.1)
    return r.select("centre_id", "cells", _r("mean_m", "mean_m", 5), _r("below_pct", "below_pct"))


@R.add("p01_p05_projection", f"with {PROFILE} select profile_id, hour_id, w as thermal_velocity_mps from hp where day = '1996-03-05' or i in (0, 3)")
def p01_p05_projection(spark, d):
    h = profile_hours(spark, d)
    day = hours.project(h, ["profile_id", "hour_id", "thermal_velocity_mps"], drop_levels=True, day="1996-03-05", zone=ZONE)
    return day.unionByName(hours.at_indices(h, [0, 3]).select(*day.columns)).distinct()


@R.add("p04_complete_hours", f"with {PROFILE} select profile_id, hour_id, (select count(*) from l join o using (hour_id) where l.hour_id = hp.hour_id and l.height_m > o.model_elevation_m + 20)::int as n_levels from hp where sd is not null and cloud is not null and w is not null and cloud_base_m is not null")
def p04_complete_hours(spark, d):
    h = hours.resolved(profile_hours(spark, d), ("height_m", "temperature_c", "dew_point_depression_c", "wind_speed_mps", "wind_direction_deg"), ("wind_direction_deg", "cloud_cover_pct", "thermal_velocity_mps", "cloud_base_m"))
    return h.select("profile_id", "hour_id", F.size("levels").alias("n_levels"))


@R.add("w02_leading_step", f"with {PROFILE} select profile_id, greatest(1.0, coalesce(floor((epoch_us(max(valid_at) filter (i = 1)) - epoch_us(min(valid_at) filter (i = 0))) / 3.6e9 + 0.5), 1.0)) as step_h from hp group by profile_id")
def w02_leading_step(spark, d):
    return hours.leading_step(profile_hours(spark, d))


@R.add("m44_t05_cap_facts", f"with {PROFILE} select profile_id, hour_id, case when lift_top is not null then lift_top >= cloud_base_m - 1 end as cloud_capped, case when cape is not null and cin is not null then cin <= -50 end as cape_capped from hp where i < 6")
def m44_t05_cap_facts(spark, d):
    h = hours.first_steps(profile_hours(spark, d), 6)
    return h.select("profile_id", "hour_id", hours.cloud_capped(F.col("usable_lift_top_m"), F.col("cloud_base_m")).alias("cloud_capped"), hours.cape_capped(F.col("cape_jkg"), F.col("cin_jkg"), -50.0).alias("cape_capped"))


def totals(spark, d):
    """Three-hour buckets of an hourly accumulation, then three-hourly totals; and an ever-growing one."""
    n, line = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), line.cast("long").alias("lead_h")).agg(F.max(n).alias("fall")).withColumn("total", F.col("fall") + (F.col("lead_h") - 1) % 3 * 100).withColumn("grown", F.col("lead_h") * 3600 + F.col("fall"))


TOTALS = "tt as (select l_orderkey as run, l_linenumber::bigint as lead_h, max(l_quantity) as fall from lineitem group by all), tot as (select *, fall + (lead_h - 1) % 3 * 100 as total, lead_h * 3600 + fall as grown from tt)"


@R.add(
    "w13_w15_rates",
    f"""with {TOTALS}, b as (select *, floor((lead_h - 1) / 3) * 3 as start_h from tot) select run, lead_h, round(case when lead_h > 5 then total / 3 when lead_h - start_h = 1 then total else total - (select p.total from tot p where p.run = b.run and p.lead_h = b.lead_h - 1) end, 6) as rate,
 round((grown - lag(grown) over (partition by run order by lead_h)) / ((lead_h - lag(lead_h) over (partition by run order by lead_h)) * 3600.0), 6) as flux from b""",
)
def w13_w15_rates(spark, d):
    r = hours.flux_rates(hours.bucket_rates(totals(spark, d), ["run"], "lead_h", "total", F.lit(3), 5), ["run"], "lead_h", "grown")
    return r.select("run", "lead_h", _r("rate", "rate"), _r("flux", "flux"))


@R.add(
    "w20_samples_on_columns",
    f"""with {PROFILE}, hh as (select profile_id, i, epoch_us(valid_at) as t, epoch_us(lead(valid_at) over w) as nx, epoch_us(valid_at) - epoch_us(lag(valid_at) over w) as back from hp window w as (partition by profile_id order by i)),
ss as (select (o_orderkey % 250) as profile_id, o_orderkey as sample_id, epoch_us(o_orderdate + (o_orderkey % 7)::int * interval 5 hour) as t, o_orderkey % 3 as quality from orders where o_orderkey % 4 = 0),
z0 as (select profile_id, t as t0, coalesce(nx - t, 3600000000) as st0 from hh where i = 0),
j as (select ss.*, t0, st0, (select arg_max(hh.i, hh.i) from hh where hh.profile_id = ss.profile_id and hh.t <= ss.t) as hi from ss join z0 using (profile_id)),
k as (select j.profile_id, sample_id, j.t, quality, case when hi is null then case when j.t >= t0 - st0 / 2 then (j.t - t0) / st0::double end when hh.nx is not null then hi + (j.t - hh.t) / (hh.nx - hh.t)::double when j.t <= hh.t + coalesce(back, 3600000000) / 2 then hi + (j.t - hh.t) / coalesce(back, 3600000000)::double end as off from j left join hh on hh.profile_id = j.profile_id and hh.i = hi)
select profile_id, sample_id, round(off, 6) as column_offset, quality > 1 as degraded, quality <= 1 and coalesce(t - lag(t) over (partition by profile_id, quality > 1 order by t, sample_id) > 200 * 60 * 60000000::bigint, false) as breaks from k where off is not null""",
)
def w20_samples_on_columns(spark, d):
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 7 * 5).cast("int"))
    s = table(spark, d, "orders").where(k % 4 == 0).select((k % 250).alias("profile_id"), at.alias("at"), k.cast("double").alias("value"), (k % 3).alias("quality"))
    x = hours.on_hour_columns(s, profile_hours(spark, d).select("profile_id", "hour_index", "valid_at"), 200 * 60.0, 1)
    return x.select("profile_id", F.col("value").cast("long").alias("sample_id"), _r("column_offset", "column_offset"), "degraded", "breaks")


@R.add(
    "w23_pressure_ticks",
    f"""with {LEVELS}, g as (select hour_id % 20 as profile_id, pressure_hpa, floor(quantile_cont(height_m, 0.5) + 0.5)::double as altitude_m from l group by all), e as (select profile_id, altitude_m, pressure_hpa from g union all select distinct hour_id % 20, 412.0::double, null::double from l),
t as (select *, altitude_m - lag(altitude_m) over (partition by profile_id order by altitude_m, pressure_hpa is null, pressure_hpa desc) as gap from e) select profile_id, pressure_hpa, altitude_m from t where gap is null or gap >= 80""",
)
def w23_pressure_ticks(spark, d):
    rows = forecast_level(spark, d).select((F.col("hour_id") % 20).alias("profile_id"), "pressure_hpa", "height_m")
    return hours.pressure_ticks(rows, F.lit(411.5))


def station_places(spark, d):
    return station_history(spark, d).select("station_id").distinct().select("station_id", F.when(F.col("station_id") % 9 != 0, 45.0 + F.col("station_id") % 20).alias("latitude"), (-130.0 + F.col("station_id") % 30).alias("longitude"))


@R.add(
    "m46_vertical_nodes",
    f"""with {PROFILE}, cl as (select hour_id, 0 as i, model_elevation_m as z, temperature_c as t, dew_point_depression_c as d, ((hour_id * 7) % 150)::double / 10.0::double as s, case when hour_id % 11 <> 0 then ((hour_id * 53) % 360)::double end as w from o where hour_id in (select hour_id from a)
  union all select a.hour_id, a.i, a.z, a.lt, a.ld, l.wind_speed_mps, l.wind_direction_deg from a join l on l.hour_id = a.hour_id and l.height_m = a.z),
cn as (select *, lead(z) over n as z2, lead(t) over n as t2, lead(s) over n as s2, lead(w) over n as w2, lag(z) over n as z0, lag(t) over n as t0 from cl window n as (partition by hour_id order by i)),
nd as (select hour_id, 'lapse' as kind, z as altitude_m, case when z2 is not null then (t2 - t) / (z2 - z) * 1000 else (t - t0) / (z - z0) * 1000 end * 0.3048 as value from cn union all select hour_id, 'depression', z, d from cn
  union all select hour_id, 'humidity', z, least(100.0, 100 * exp(17.625 * (t - d) / (243.04 + (t - d)) - 17.625 * t / (243.04 + t))) from cn
  union all select hour_id, 'shear', (z + z2) / 2, sqrt(pow(-s2 * sin(w2 * {RAD}) + s * sin(w * {RAD}), 2) + pow(-s2 * cos(w2 * {RAD}) + s * cos(w * {RAD}), 2)) / (z2 - z) * 1000 from cn where z2 is not null)
select hour_id, kind, round(altitude_m, 6) as altitude_m, case when kind in ('lapse', 'depression') then value else round(value, 7) end as value from nd""",
)
def m46_vertical_nodes(spark, d):
    k = F.col("hour_id")
    h = derive.with_levels(forecast_hour(spark, d), forecast_level(spark, d))
    h = h.withColumn("wind_speed_mps", (k * 7 % 150).cast("double") / 10.0).withColumn("wind_direction_deg", F.when(k % 11 != 0, (k * 53 % 360).cast("double")))
    return vertical.nodes(h).select("hour_id", "kind", _r("altitude_m", "altitude_m"), F.when(F.col("kind").isin("lapse", "depression"), F.col("value")).otherwise(F.round("value", 7)).alias("value"))


@R.add(
    "j18_wind_pairs",
    f"""with {MEMBERS}, w as (select hour_id % 40 as site, hour_id // 40 * 32 + member // 2 as member, member % 2 as c, v from m), p as (select site, member, max(v) filter (c = 0) as u, max(v) filter (c = 1) as v from w group by all)
select site, member, round(sqrt(u * u + v * v), 6) as speed_mps, round((atan2(-u, -v) / ({RAD}) % 360 + 360) % 360, 4) % 360 as direction_deg from p where u is not null and v is not null""",
)
def j18_wind_pairs(spark, d):
    m = member_value(spark, d)
    w = m.select((F.col("hour_id") % 40).alias("site"), (F.floor(F.col("hour_id") / 40) * 32 + F.floor(F.col("member") / 2)).alias("member"), F.when(F.col("member") % 2 == 0, "u").otherwise("v").alias("component"), F.col("v").alias("value"))
    return vertical.wind_pairs(w, ["site"]).select("site", "member", _r("speed_mps", "speed_mps"), F.pmod(F.round("direction_deg", 4), F.lit(360.0)).alias("direction_deg"))


@R.add("m24_m25_parcel_ascents")
def m24_m25_parcel_ascents(spark, d):
    h = derive.with_levels(forecast_hour(spark, d), forecast_level(spark, d))
    x = parcel.ascents(h).select("hour_id", "lcl_m", F.explode("levels").alias("l"))
    return x.select("hour_id", _r("lcl_m", "lcl_m", 4), "l.height_m", _r("l.parcel_c", "parcel_c"), _r("l.thermal_index_c", "thermal_index_c"))


@R.add("w24_nights")
def w24_nights(spark, d):
    return nights.nights(station_history(spark, d).withColumn("observed_at", F.col("observed_at").cast("timestamp")), station_places(spark, d))


@R.add("w25_last_night_low")
def w25_last_night_low(spark, d):
    h = station_history(spark, d).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return nights.last_night_low(h, station_places(spark, d), F.lit("2024-01-20 20:00:00").cast("timestamp"))


@R.add("r30_nearest_point", f"with {HISTORY} select station_id, arg_min(seq, (abs(epoch_us(observed_at) - epoch_us(timestamp '2024-01-15 07:30:00')), observed_at, seq)) as seq, arg_min(observed_at, (abs(epoch_us(observed_at) - epoch_us(timestamp '2024-01-15 07:30:00')), observed_at, seq)) as observed_at from h group by station_id")
def r30_nearest_point(spark, d):
    h = station_history(spark, d)
    return station.nearest_point(h, h.select("station_id").distinct().withColumn("at", F.lit("2024-01-15 07:30:00").cast("timestamp")))


@R.add("v09_graded_segments", f"with {HISTORY}, x as (select *, lag(wind_avg_mps) over w as pw, lag(observed_at) over w as from_at from h window w as (partition by station_id order by observed_at, seq)) select station_id, seq, observed_at, from_at, (case when (pw + wind_avg_mps) / 2 >= 2 then 1 else 0 end + case when (pw + wind_avg_mps) / 2 >= 5 then 1 else 0 end)::int as band from x where from_at is not null")
def v09_graded_segments(spark, d):
    return station.graded_segments(station_history(spark, d), (2.0, 5.0))


@R.add("r28_r29_scales", f"with {HISTORY} select station_id, bool_and(coalesce(wind_gust_mps, wind_avg_mps) < 0.5) as calm, coalesce(min(temperature_c), 0.0) - 2 as low, coalesce(max(temperature_c), 0.0) + 2 as high from h group by station_id")
def r28_r29_scales(spark, d):
    h = station_history(spark, d)
    return station.all_calm(h).join(station.value_scale(h, "temperature_c", 2.0), "station_id")


@R.add("r17_observation_manifest", f"with {HISTORY} select (station_id % 3)::varchar as model, min(observed_at) as first_observed_at, max(observed_at) as last_observed_at, max(observed_at) as reference_time, count(*) as observations, count(distinct station_id) as sites from h group by 1")
def r17_observation_manifest(spark, d):
    return documents.observation_manifest(station_history(spark, d).select((F.col("station_id") % 3).cast("string").alias("model"), F.col("station_id").alias("site"), "observed_at"))


@R.add(
    "s23_s27_guarded_documents",
    """with r as (select c_custkey as path, case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 'no json' else '{"schemaVersion": ' || (c_custkey % 4)::varchar || ', "model": ' || case when c_custkey % 7 = 0 then 'null' else '"m' || (c_custkey % 3)::varchar || '"' end || '}' end as body from customer)
select path, case when c then 'm' || (path % 3)::varchar end as model, case when body is null then 'absent' when not c then 'invalid' end as miss, case when body is not null and not c and body <> 'no json' then (path % 4)::double end as declared_version, case when body is not null and not c then 2 end as supported_version
from (select *, coalesce(body <> 'no json' and path % 4 in (1, 2) and path % 7 <> 0, false) as c from r) t""",
)
def s23_s27_guarded_documents(spark, d):
    k = F.col("c_custkey")
    model = F.when(k % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"m'), (k % 3).cast("string"), F.lit('"')))
    body = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit("no json")).otherwise(F.concat(F.lit('{"schemaVersion": '), (k % 4).cast("string"), F.lit(', "model": '), model, F.lit("}")))
    x = documents.guarded(table(spark, d, "customer").select(k.alias("path"), body.alias("body")), "schemaVersion int, model string", (1, 2), ("model",))
    return x.select("path", "doc.model", "miss", "declared_version", "supported_version")


@R.add(
    "s35_upload_plan",
    """with f as (select 'm' || (o_orderkey % 3)::varchar as model, case o_orderkey % 4 when 0 then 'archive' when 1 then 'index' when 2 then 'site' else 'manifest' end as kind, 's' || (o_custkey % 50)::varchar as site, strftime(o_orderdate, '%Y-%m') as month from orders), u as (select distinct model, kind, case when kind <> 'manifest' then site end as site, case when kind in ('archive', 'index') then month end as month from f),
r as (select *, coalesce(month in ('1998-03', '1998-02'), false) as o from u)
select model, kind, case when kind = 'manifest' then 5 when kind = 'site' then 4 else (case when o then 0 else 2 end) + (case when kind = 'index' then 1 else 0 end) end as rank, kind in ('site', 'manifest') or o as live,
 case kind when 'manifest' then model || '/manifest.json' when 'site' then model || '/sites/' || site || '.json' when 'archive' then model || '/history/' || site || '/' || month || '.jsonl.gz' else model || '/history/' || site || '/' || month || '.index.json' end as key from r""",
)
def s35_upload_plan(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "archive").when(k % 4 == 1, "index").when(k % 4 == 2, "site").otherwise("manifest")
    f = table(spark, d, "orders").select(F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), kind.alias("kind"), F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("site"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    f = f.withColumn("site", F.when(F.col("kind") != "manifest", F.col("site"))).withColumn("month", F.when(F.col("kind").isin("archive", "index"), F.col("month"))).distinct()
    return documents.upload_plan(f, F.lit("1998-03-01 00:30:00").cast("timestamp")).select("model", "kind", "rank", "live", "key")


@R.add("s38_j05_context_freshness", "with s as (select c_custkey as slug, c_acctbal as a, c_nationkey::double as b from customer), c as (select c_custkey as slug, case when c_custkey % 11 = 0 then c_acctbal + 0.5 else c_acctbal end as a, c_nationkey::double as b from customer where c_custkey % 13 <> 0) select bool_and(coalesce(s.a = c.a and s.b = c.b, false)) as fresh, count(*) filter (not coalesce(s.a = c.a and s.b = c.b, false)) as stale_sites from s left join c using (slug)")
def s38_j05_context_freshness(spark, d):
    k, a, b = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    t = table(spark, d, "customer")
    sites = t.select(k.alias("slug"), a.alias("latitude"), b.alias("longitude"))
    context = t.where(k % 13 != 0).select(k.alias("slug"), F.when(k % 11 == 0, a + 0.5).otherwise(a).alias("latitude"), b.alias("longitude"))
    return documents.context_freshness(sites, context)


@R.add("d02_cycles", "with s as (select o_orderkey as k, strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad((o_orderkey % 24)::varchar, 2, '0') || case when o_orderkey % 5 = 0 then ':30:00Z' else ':00:00Z' end as stamp from orders) select k, case when k % 5 <> 0 and k % 24 in (0, 6, 12, 18) then replace(stamp[1:10], '-', '') end as date, case when k % 5 <> 0 and k % 24 in (0, 6, 12, 18) then lpad((k % 24)::varchar, 2, '0') end as hour from s")
def d02_cycles(spark, d):
    k = F.col("o_orderkey")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.when(k % 5 == 0, ":30:00Z").otherwise(":00:00Z"))
    return table(spark, d, "orders").select(k.alias("k"), documents.cycle(stamp, ("00", "06", "12", "18")).alias("c")).select("k", "c.date", "c.hour")


@R.add(
    "t07_newest_complete_cycle",
    "with c as (select o_orderpriority as model, o_orderdate + (o_orderkey % 4)::int * interval 6 hour as ref, o_orderkey % 3 <> 0 as complete from orders) select model, max(ref) as reference_time from c where complete and ref <= timestamp '1998-06-10 13:00:00' and ref >= timestamp '1998-06-09 00:00:00' group by model",
)
def t07_newest_complete_cycle(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 4 * 6).cast("int"))).alias("reference_time"), (k % 3 != 0).alias("complete"))
    return at_utc(hours.newest_complete(c, F.lit("1998-06-10 13:00:00").cast("timestamp")), "reference_time")


@R.add(
    "p20_resolve_station",
    "with s as (select c_nationkey as feed_id, c_custkey as station_id, row_number() over (partition by c_nationkey order by c_custkey desc) as place from customer), a as (select *, case when feed_id % 3 = 0 then feed_id + 30 end as asked, feed_id * 7 + 5 as prim from s) select feed_id, arg_min(station_id, (case when asked is not null then 0 when station_id = prim then 0 else 1 end, place)) as station_id from a where asked is null or station_id = asked group by feed_id",
)
def p20_resolve_station(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("feed_id"), F.col("c_custkey").alias("station_id"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_custkey").desc())).alias("place"))
    return documents.resolve_station(t, F.when(F.col("feed_id") % 3 == 0, F.col("feed_id") + 30), F.col("feed_id") * 7 + 5)


FRAMES = "fr as (select user_id as station_id, event_id as seq, case when event_id % 7 = 0 then 'init' when event_id % 7 < 3 then 'reading' when event_id % 7 = 3 then 'summaries' when event_id % 7 = 4 then 'ping' when event_id % 7 = 5 then 'samples' else 'unavailable' end as kind, case when event_id % 14 = 0 then 'ok' else 'down' end as status, ts as served_at, value as reading, event_id % 100 as summaries from events)"


@R.add(
    "st01_snapshots",
    f"""with {FRAMES}, i as (select station_id, max(seq) as iseq, arg_max(status, seq) as ist, arg_max(reading, seq) as ir, arg_max(summaries, seq) as isum from fr where kind = 'init' group by 1), x as (select * from fr left join i using (station_id) where kind <> 'ping'),
g as (select station_id, any_value(ist) as station_status, any_value(ir) as ir, any_value(isum) as isum, arg_max(reading, seq) filter (kind = 'reading' and seq > iseq and ist = 'ok') as r, arg_max(summaries, seq) filter (kind = 'summaries' and seq > iseq and ist = 'ok') as s, arg_max(served_at, seq) filter (kind in ('init', 'reading', 'summaries')) as served_at, arg_max(kind, seq) as last_kind, count(*) filter (kind <> 'unavailable') as n from x group by 1)
select station_id, station_status, coalesce(r, ir) as reading, coalesce(s, isum) as summaries, served_at, case when n > 0 then 'open' else 'connecting' end as status, case when last_kind = 'unavailable' then 'network' end as error from g""",
)
def st01_snapshots(spark, d):
    k = F.col("event_id") % 7
    kind = F.when(k == 0, "init").when(k < 3, "reading").when(k == 3, "summaries").when(k == 4, "ping").when(k == 5, "samples").otherwise("unavailable")
    f = table(spark, d, "events").select(F.col("user_id").alias("station_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 14 == 0, "ok").otherwise("down").alias("status"), F.col("ts").alias("served_at"), F.col("value").alias("reading"), (F.col("event_id") % 100).alias("summaries"))
    return live.snapshots(f)
