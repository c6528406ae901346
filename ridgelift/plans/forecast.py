"""Forecast derivation, ensembles and scalar functions over forecast hours and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.functions import air, numbers, sun, wind
from ridgelift.operators import derive, ensemble
from ridgelift.sources.projections import HISTORY, HOURS, LEVELS, MEMBERS, forecast_hour, forecast_level, member_value, station_history, table

from .registry import Registry

R = Registry()


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


PCT = "round(quantile_cont(v, {p}), 6) as p{n}"


@R.add("a01_a02_percentile_block", f"with {MEMBERS} select hour_id, count(v)::int as members, {', '.join(PCT.format(p=p / 100, n=p) for p in (10, 25, 50, 75, 90))} from m group by hour_id")
def a01_a02_percentile_block(spark, d):
    r = ensemble.block(member_value(spark, d), ["hour_id"], "v")
    return r.select("hour_id", "members", *[_r(f"p{p}") for p in ensemble.POINTS])


@R.add(
    "a03_circular_median",
    f"""with {MEMBERS}, b as (select hour_id, ((v * 10) % 360 + 360) % 360 as deg from m where v is not null), a as (select hour_id, atan2(sum(sin(deg * pi() / 180)), sum(cos(deg * pi() / 180))) * (180 / pi()) as anchor from b group by hour_id),
u as (select hour_id, anchor + (((deg - anchor + 180) % 360 + 360) % 360) - 180 as x from b join a using (hour_id)) select hour_id, round((quantile_cont(x, 0.5) % 360 + 360) % 360, 5) as circular_median_deg from u group by hour_id""",
)
def a03_circular_median(spark, d):
    m = member_value(spark, d).withColumn("deg", F.pmod(F.col("v") * 10, F.lit(360.0)))
    return ensemble.circular_median(m, ["hour_id"], "deg").select("hour_id", _r("circular_median_deg", 5))


@R.add("a05_ceiled_members", f"with {MEMBERS} select hour_id, count(*) filter (v >= 10 + member % 7 - 0.5) as ceiled_members from m group by hour_id")
def a05_ceiled_members(spark, d):
    top = (10 + F.col("member") % 7).cast("double")
    return member_value(spark, d).groupBy("hour_id").agg(ensemble.ceiled(F.col("v"), top).alias("ceiled_members"))


@R.add(
    "a04_a07_levels_by_pressure",
    f"""with {HOURS}, {LEVELS} select valid_at, pressure_hpa, count(*)::int as members, round(quantile_cont(height_m, 0.5), 6) as height_p50, round(quantile_cont(l.temperature_c, 0.1), 6) as temperature_p10, round(quantile_cont(l.temperature_c, 0.9), 6) as temperature_p90
from l join o using (hour_id) group by valid_at, pressure_hpa""",
)
def a04_a07_levels_by_pressure(spark, d):
    rows = forecast_level(spark, d).join(forecast_hour(spark, d).select("hour_id", "valid_at"), "hour_id")
    keys = ["valid_at", "pressure_hpa"]
    heights = ensemble.block(rows, keys, "height_m").select(*keys, "members", F.round("p50", 6).alias("height_p50"))
    temps = ensemble.block(rows, keys, "temperature_c").select(*keys, F.round("p10", 6).alias("temperature_p10"), F.round("p90", 6).alias("temperature_p90"))
    return heights.join(temps, keys)


LCL = "case when dew_point_depression_c <= 0 then 0.0 else greatest(0.0, (temperature_c + 273.15 - (1.0 / (1.0 / (temperature_c - dew_point_depression_c + 273.15 - 56.0) + ln((temperature_c + 273.15) / (temperature_c - dew_point_depression_c + 273.15)) / 800.0) + 56.0)) / 0.0098) end"


@R.add("m14_lcl", f"with {HOURS} select hour_id, round({LCL}, 4) as lcl_agl_m from o")
def m14_lcl(spark, d):
    t = F.col("temperature_c")
    return forecast_hour(spark, d).select("hour_id", F.round(air.lcl_agl(t, t - F.col("dew_point_depression_c")), 4).alias("lcl_agl_m"))


# The derivation in SQL: the scans over levels become window functions over admitted levels.
DERIVED = f"""{HOURS}, {LEVELS}, a as (select hour_id, row_number() over (partition by hour_id order by height_m) as i, height_m as z, l.temperature_c as lt, l.dew_point_depression_c as ld, pressure_hpa as p, o.temperature_c as t,
  o.dew_point_depression_c as td, model_elevation_m as g from l join o using (hour_id) where height_m > model_elevation_m + 20),
n as (select *, lag(z) over w as pz, lag(lt) over w as pt, coalesce(lag(z) over w, g) as sz, coalesce(lag(ld) over w, td) as sd from a window w as (partition by hour_id order by i)),
sat as (select hour_id, arg_min(sz + (sd - 0.5) / (sd - ld) * (z - sz), i) as s from n where ld <= 0.5 group by hour_id),
blc as (select hour_id, arg_min(greatest(0.0, case when pz is null then z - g when abs(0.0098 + (lt - pt) / (z - pz)) < 0.00001 then pz - g else (t - pt + (lt - pt) / (z - pz) * (pz - g)) / (0.0098 + (lt - pt) / (z - pz)) end), i) as depth from n where not (t - (z - g) * 0.0098 > lt) group by hour_id),
top as (select hour_id, greatest(0.0, max(z) - min(g)) as depth, arg_min(p, i) as p1 from n group by hour_id),
x as (select o.*, p1, coalesce(blc.depth, top.depth, 0.0) as depth, greatest(model_elevation_m, least(model_elevation_m + ({LCL}), case when dew_point_depression_c <= 0.5 then model_elevation_m else coalesce(s, 1e300) end)) as base
  from o left join top using (hour_id) left join blc using (hour_id) left join sat using (hour_id)),
y as (select *, case when depth <= 0 or p1 is null or sensible_heat_flux_wm2 + 0.000245268 * (temperature_c + 273.15) * latent_heat_flux_wm2 <= 0 then 0.0
  else cbrt(0.0075516 / ((temperature_c + 273.15) * pow(1015 / p1, 0.28482)) * (sensible_heat_flux_wm2 + 0.000245268 * (temperature_c + 273.15) * latent_heat_flux_wm2) * depth) end as w from x),
q as (select n.hour_id, n.i, z - n.g as agl, z, depth, base, y.w, y.w * 4 * cbrt(greatest(0.0, (z - n.g) / depth)) * (1 - 0.8 * (z - n.g) / depth) as up from n join y using (hour_id) where depth > 0 and z - n.g >= depth * 0.25),
r as (select *, coalesce(lag(agl) over (partition by hour_id order by i), depth * 0.2) as pagl, coalesce(lag(up) over (partition by hour_id order by i), w * 1.97) as pup from q),
e as (select hour_id, arg_min(case when z >= base then base else least(base, z - agl + pagl + least(1.0, greatest(0.0, (1.0 - pup) / (up - pup))) * (agl - pagl)) end, i) as lift from r where z >= base or up <= 1.0 group by hour_id),
f as (select y.*, case when depth > 0 then model_elevation_m + depth end as bl_top, case when depth > 0 and w * 2.02 >= 1.0 then coalesce(lift, least(base, model_elevation_m + depth)) end as lift_top from y left join e using (hour_id))"""


def derived_hours(spark, d):
    return derive.derived(derive.with_levels(forecast_hour(spark, d), forecast_level(spark, d)))


@R.add("m16_m20_derivation_chain", f"with {DERIVED} select hour_id, round(base, 4) as cloud_base_m, round(bl_top, 4) as boundary_layer_top_m, round(w, 6) as thermal_velocity_mps, round(lift_top, 4) as usable_lift_top_m from f")
def m16_m20_derivation_chain(spark, d):
    return derived_hours(spark, d).select("hour_id", _r("cloud_base_m", 4), _r("boundary_layer_top_m", 4), _r("thermal_velocity_mps"), _r("usable_lift_top_m", 4))


@R.add("p07_level_admission", f"with {HOURS}, {LEVELS} select hour_id, count(height_m)::int as n_levels, min(height_m) as lowest_m from o left join (select * from l) l using (hour_id) where height_m > model_elevation_m + 20 group by hour_id")
def p07_level_admission(spark, d):
    h = derive.with_levels(forecast_hour(spark, d), forecast_level(spark, d)).where(F.size("levels") > 0)
    return h.select("hour_id", F.size("levels").alias("n_levels"), F.element_at("levels", 1)["height_m"].alias("lowest_m"))


@R.add("p11_published_levels", f"with {LEVELS} select hour_id, level_index, round(temperature_c - dew_point_depression_c, 6) as dew_point_c, greatest(0, wind_speed_mps) as wind_speed_mps, wind_direction_deg from l")
def p11_published_levels(spark, d):
    return derive.published_levels(forecast_level(spark, d)).select("hour_id", "level_index", _r("dew_point_c"), "wind_speed_mps", "wind_direction_deg")


@R.add("p08_complete_levels", f"with {LEVELS} select hour_id, count(*) filter (height_m is not null and temperature_c is not null and dew_point_depression_c is not null and wind_speed_mps is not null) as complete from l group by hour_id having count(*) filter (height_m is not null and temperature_c is not null and dew_point_depression_c is not null and wind_speed_mps is not null) >= 3")
def p08_complete_levels(spark, d):
    whole = F.lit(True)
    for c in ("height_m", "temperature_c", "dew_point_depression_c", "wind_speed_mps"):
        whole = whole & F.col(c).isNotNull()
    return forecast_level(spark, d).groupBy("hour_id").agg(F.count_if(whole).alias("complete")).where("complete >= 3")


E_S = "6.1094 * exp(17.625 * {t} / (243.04 + {t}))"


@R.add(
    "m12_m13_moisture",
    f"""with {LEVELS}, x as (select *, temperature_c - dew_point_depression_c as td from l), y as (select *, 0.622 * {E_S.format(t='td')} / (pressure_hpa - {E_S.format(t='td')}) as w, least(100, 100 * exp(17.625 * td / (243.04 + td) - 17.625 * temperature_c / (243.04 + temperature_c))) as rh from x),
g as (select *, ln(least(100, greatest(1, rh)) / 100) + 17.625 * temperature_c / (243.04 + temperature_c) as gam from y)
select hour_id, level_index, round({E_S.format(t='temperature_c')}, 6) as e_s, round(rh, 6) as rh, round(243.04 * gam / (17.625 - gam), 6) as dew_back, round(w, 9) as w, round((temperature_c + 273.15) * (1 + w / 0.622) / (1 + w) - 273.15, 6) as t_virtual from g""",
)
def m12_m13_moisture(spark, d):
    t, p = F.col("temperature_c"), F.col("pressure_hpa")
    dew = t - F.col("dew_point_depression_c")
    rh, w = air.relative_humidity(t, dew), air.mixing_ratio(dew, p)
    return forecast_level(spark, d).select("hour_id", "level_index", F.round(air.saturation_pressure(t), 6).alias("e_s"), F.round(rh, 6).alias("rh"), F.round(air.dew_point(t, rh), 6).alias("dew_back"), F.round(w, 9).alias("w"), F.round(air.virtual_temperature(t, w), 6).alias("t_virtual"))


@R.add(
    "m21_m23_lapse_stability_shear",
    f"""with {LEVELS}, x as (select *, lead(height_m) over w as z2, lead(temperature_c) over w as t2, -wind_speed_mps * sin(wind_direction_deg * pi() / 180) as u, -wind_speed_mps * cos(wind_direction_deg * pi() / 180) as v from l window w as (partition by hour_id order by level_index)),
y as (select *, case when z2 <> height_m then (t2 - temperature_c) / (z2 - height_m) * 1000 end as lapse, lead(u) over w as u2, lead(v) over w as v2 from x window w as (partition by hour_id order by level_index))
select hour_id, level_index, round(lapse, 6) as lapse_c_km, case when lapse * 0.3048 <= -3 then 'very-unstable' when lapse * 0.3048 <= -2.5 then 'unstable' when lapse * 0.3048 <= -2 then 'conditional-strong' when lapse * 0.3048 <= -1.5 then 'conditional'
 when lapse * 0.3048 <= -1.2 then 'near-neutral' when lapse * 0.3048 <= 0 then 'stable' when lapse * 0.3048 <= 0.5 then 'inverted' else 'strong-inversion' end as stability, round(sqrt((u2 - u) * (u2 - u) + (v2 - v) * (v2 - v)), 6) as shear_mps from y where z2 is not null""",
)
def m21_m23_lapse_stability_shear(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("hour_id").orderBy("level_index")
    rows = forecast_level(spark, d).withColumn("u", wind.u_of(F.col("wind_speed_mps"), F.col("wind_direction_deg"))).withColumn("v", wind.v_of(F.col("wind_speed_mps"), F.col("wind_direction_deg")))
    for c in ("height_m", "temperature_c", "u", "v"):
        rows = rows.withColumn(f"{c}_up", F.lead(c).over(w))
    lapse = air.lapse_per_km(F.col("temperature_c"), F.col("height_m"), F.col("temperature_c_up"), F.col("height_m_up"))
    return rows.where("height_m_up is not null").select("hour_id", "level_index", F.round(lapse, 6).alias("lapse_c_km"), air.stability(lapse * (air.FEET_1000 / 1000)).alias("stability"), F.round(wind.shear(F.col("u"), F.col("v"), F.col("u_up"), F.col("v_up")), 6).alias("shear_mps"))


@R.add("m01_m04_wind_components", f"with {HISTORY}, x as (select seq, -wind_avg_mps * sin(wind_direction_deg * pi() / 180) as u, -wind_avg_mps * cos(wind_direction_deg * pi() / 180) as v from h) select seq, round(u, 6) as u, round(v, 6) as v, round(sqrt(u * u + v * v), 6) as speed, round(case when u = 0 and v = 0 then 0 else (atan2(-u, -v) / (pi() / 180) % 360 + 360) % 360 end, 4) as deg from x where u is not null")
def m01_m04_wind_components(spark, d):
    s, deg = F.col("wind_avg_mps"), F.col("wind_direction_deg")
    x = station_history(spark, d).where(deg.isNotNull()).select("seq", wind.u_of(s, deg).alias("u"), wind.v_of(s, deg).alias("v"))
    u, v = F.col("u"), F.col("v")
    return x.select("seq", _r("u"), _r("v"), F.round(wind.speed_of(u, v), 6).alias("speed"), F.round(wind.direction_of(u, v), 4).alias("deg"))


COSZ = """g as (select *, (dayofyear(observed_at) - 1 + (hour(observed_at) + minute(observed_at) / 60.0::double + second(observed_at) / 3600.0::double) / 24) * (2 * pi() / 365) as gm, hour(observed_at) + minute(observed_at) / 60.0::double + second(observed_at) / 3600.0::double as hh, 50.0 + station_id % 10 as lat, -120.0 + station_id % 7 as lon from h),
z as (select *, 0.006918 - 0.399912 * cos(gm) + 0.070257 * sin(gm) - 0.006758 * cos(2 * gm) + 0.000907 * sin(2 * gm) - 0.002697 * cos(3 * gm) + 0.00148 * sin(3 * gm) as dec, 229.18 * (0.000075 + 0.001868 * cos(gm) - 0.032077 * sin(gm) - 0.014615 * cos(2 * gm) - 0.040849 * sin(2 * gm)) as eot from g),
c as (select *, sin(lat * pi() / 180) * sin(dec) + cos(lat * pi() / 180) * cos(dec) * cos((hh + lon / 15 + eot / 60 - 12) * 15 * pi() / 180) as cz from z)"""


@R.add("m26_m28_sun_and_smoke", f"with {HISTORY}, {COSZ} select seq, round(cz, 6) as cosz, round(case when cz > 0 then 1098 * cz * exp(-0.059 / cz) else 0 end, 4) as ghi, round(case when cz >= 0.15 then least(1.5, wind_avg_mps * 100 / (1098 * cz * exp(-0.059 / cz))) end, 6) as seen, round(case when wind_avg_mps > 0 and cz > 0 then exp(-0.13 * wind_avg_mps / greatest(cz, 0.15)) else 1 end, 6) as smoke from c")
def m26_m28_sun_and_smoke(spark, d):
    cz = sun.cos_zenith(F.col("observed_at"), F.lit(50.0) + F.col("station_id") % 10, F.lit(-120.0) + F.col("station_id") % 7)
    x = station_history(spark, d).withColumn("cz", cz)
    cz = F.col("cz")
    return x.select("seq", F.round(cz, 6).alias("cosz"), F.round(sun.clear_sky_ghi(cz), 4).alias("ghi"), F.round(sun.observed_transmittance(F.col("wind_avg_mps") * 100, cz), 6).alias("seen"), F.round(air.smoke_transmittance(F.col("wind_avg_mps"), cz), 6).alias("smoke"))


@R.add("m30_m35_pressure", f"with {LEVELS} select hour_id, level_index, round(pressure_hpa * pow(1 - 0.0065 * height_m / (temperature_c + 0.0065 * height_m + 273.15), -5.257), 4) as slp, round(-(pressure_hpa * 100 / (287.05 * (temperature_c + 273.15))) * 9.80665 * 0.5, 6) as omega from l")
def m30_m35_pressure(spark, d):
    p, z, t = F.col("pressure_hpa"), F.col("height_m"), F.col("temperature_c")
    return forecast_level(spark, d).select("hour_id", "level_index", F.round(air.sea_level_pressure(p, z, t), 4).alias("slp"), F.round(air.omega(F.lit(0.5), p, t), 6).alias("omega"))


@R.add("m33_m34_freshness", "select o_orderkey as k, case when age <= 10 then 'live' when age <= 45 then 'aging' else 'stale' end as reading, case when age <= 1 * 6 + 5 then 'current' when age <= 3 * 6 + 5 then 'delayed' else 'stale' end as run from (select o_orderkey, o_orderkey % 60 as age from orders) t")
def m33_m34_freshness(spark, d):
    from ridgelift.functions import times

    age = F.col("o_orderkey") % 60
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), times.reading_freshness(age * 60).alias("reading"), times.run_freshness(age, 6, 5, 1, 3).alias("run"))


@R.add("p09_sentinel", f"with {HOURS} select hour_id, case when not (abs(temperature_c - 9.7) <= 0.5) then temperature_c end as t from o")
def p09_sentinel(spark, d):
    return forecast_hour(spark, d).select("hour_id", numbers.masked(F.col("temperature_c"), 9.7).alias("t"))


def _sun_sql() -> str:
    """Both passes of both events, as chained selects."""
    rad = "(pi() / 180)"
    parts = ["s0 as (select hour_id, valid_at::date as day, 49.0::double + site_id % 5 as lat, -123.0::double + site_id % 9 as lon, 0.0::double as at_rise, 0.0::double as at_set from o)"]
    for k in (1, 2):
        select = [f"s{k - 1}.*"]
        for name in ("rise", "set"):
            select.append(f"(date_diff('day', date '2000-01-01', day) - 0.5 + at_{name}) / 36525.0::double as c_{name}")
        parts.append(f"a{k} as (select {', '.join(select)} from s{k - 1})")
        select = ["*"]
        for n in ("rise", "set"):
            c = f"c_{n}"
            select += [f"((280.46646 + {c} * (36000.76983 + {c} * 0.0003032)) % 360 + 360) % 360 as ml_{n}", f"(357.52911 + {c} * (35999.05029 - {c} * 0.0001537)) * {rad} as an_{n}", f"(125.04 - {c} * 1934.136) * {rad} as no_{n}", f"0.016708634 - {c} * (0.000042037 + {c} * 0.0000001267) as ec_{n}"]
        parts.append(f"b{k} as (select {', '.join(select)} from a{k})")
        select = ["*"]
        for n in ("rise", "set"):
            c = f"c_{n}"
            select += [
                f"(ml_{n} + sin(an_{n}) * (1.914602 - {c} * (0.004817 + {c} * 0.000014)) + sin(an_{n} * 2) * (0.019993 - {c} * 0.000101) + sin(an_{n} * 3) * 0.000289 - 0.00569 - sin(no_{n}) * 0.00478) * {rad} as ap_{n}",
                f"(23 + (26 + (21.448 - {c} * (46.815 + {c} * (0.00059 - {c} * 0.001813))) / 60) / 60 + cos(no_{n}) * 0.00256) * {rad} as ti_{n}",
            ]
        parts.append(f"d{k} as (select {', '.join(select)} from b{k})")
        select = ["hour_id", "day", "lat", "lon"]
        for n, sign in (("rise", "-"), ("set", "+")):
            y, m, e, a = f"pow(tan(ti_{n} / 2), 2)", f"(ml_{n} * {rad})", f"ec_{n}", f"an_{n}"
            eot = f"({y} * sin(2 * {m}) - 2 * {e} * sin({a}) + 4 * {e} * {y} * sin({a}) * cos(2 * {m}) - 0.5 * {y} * {y} * sin(4 * {m}) - 1.25 * {e} * {e} * sin(2 * {a})) / {rad} * 4"
            dec = f"asin(sin(ti_{n}) * sin(ap_{n}))"
            ha = f"acos(cos(90.833 * {rad}) / (cos(lat * {rad}) * cos({dec})) - tan(lat * {rad}) * tan({dec})) / {rad}"
            select.append(f"(720 - 4 * (lon {'+' if sign == '-' else '-'} {ha}) - {eot}) / 60{' / 24' if k == 1 else ''} as at_{n}")
        parts.append(f"s{k} as (select {', '.join(select)} from d{k})")
    return f"with {HOURS}, {', '.join(parts)} select hour_id, round(at_rise, 4) as sunrise_h, round(at_set, 4) as sunset_h from s2"


@R.add("m29_sunrise_sunset", _sun_sql())
def m29_sunrise_sunset(spark, d):
    at = F.col("valid_at").cast("date")
    lat, lon = F.lit(49.0) + F.col("site_id") % 5, F.lit(-123.0) + F.col("site_id") % 9
    return forecast_hour(spark, d).select("hour_id", F.round(sun.sun_event(at, lat, lon, False), 4).alias("sunrise_h"), F.round(sun.sun_event(at, lat, lon, True), 4).alias("sunset_h"))
