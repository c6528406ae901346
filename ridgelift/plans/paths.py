"""Metric paths into profiles, and first differences of pairs of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.operators import paths
from ridgelift.sources.projections import HOURS, LEVELS, forecast_hour, forecast_level, table

from .registry import Registry

R = Registry()


def profiles(spark, d):
    """A profile a site: its hours in order, with surface, derived values of an ensemble, and levels."""
    level = F.struct("height_m", "pressure_hpa", "temperature_c", "wind_speed_mps")
    levels = forecast_level(spark, d).groupBy("hour_id").agg(F.array_sort(F.collect_list(level)).alias("levels"))
    h = forecast_hour(spark, d).join(levels, "hour_id", "left")
    lift = F.struct(F.lit(5).alias("members"), *[(F.col("latent_heat_flux_wm2") + q).alias(f"p{q}") for q in (10, 25, 50, 75, 90)])
    hour = F.struct("valid_at", "hour_id", F.struct("temperature_c", F.struct(F.col("dew_point_depression_c").alias("depression")).alias("moist")).alias("surface"), F.struct(lift.alias("lift"), "sensible_heat_flux_wm2").alias("derived"), "levels")
    site = F.struct(F.max("model_elevation_m").alias("elevation_m"))
    return h.groupBy("site_id").agg(F.array_sort(F.collect_list(hour)).alias("hours"), site.alias("site")).withColumn("launch", F.struct((F.col("site.elevation_m") + 50).alias("elevation_m")))


@R.add(
    "d18_metric_paths",
    f"""with {HOURS}, {LEVELS}, n as (select *, row_number() over (partition by site_id order by valid_at, hour_id) - 1 as i from o), h as (select * from n where i = 1), s as (select site_id, max(model_elevation_m) as elevation_m from o group by site_id),
p as (select hour_id, temperature_c as t975 from l where pressure_hpa = 975), q as (select hour_id, arg_min(wind_speed_mps, (abs(height_m - 1500), height_m)) as near from l group by hour_id)
select s.site_id, s.elevation_m as site_elevation_m, s.elevation_m + 50 as launch_elevation_m, h.temperature_c, h.dew_point_depression_c as depression, h.sensible_heat_flux_wm2 as flux, h.latent_heat_flux_wm2 + 50 as lift_p50, t975, near from s left join h using (site_id) left join p using (hour_id) left join q using (hour_id)""",
)
def d18_metric_paths(spark, d):
    p = profiles(spark, d)
    m = lambda text, **how: paths.metric(p, text, **how)
    return p.select(
        "site_id", m("site.elevation_m").alias("site_elevation_m"), m("launch.elevation_m").alias("launch_elevation_m"), m("surface.temperature_c", hour=1).alias("temperature_c"), m("surface.moist.depression", hour=1).alias("depression"), m("derived.sensible_heat_flux_wm2", hour=1).alias("flux"),
        m("derived.lift.p50", hour=1).alias("lift_p50"), m("level.temperature_c", hour=1, pressure_hpa=975.0).alias("t975"), m("level.wind_speed_mps", hour=1, near_height_m=1500.0).alias("near"),
    )


@R.add(
    "d21_first_differences",
    """with t as (select o_orderkey as k, o_orderkey % 5 as m, o_totalprice as price, o_orderpriority as priority from orders)
select k as id, case m when 1 then 'lift.depth.1' when 2 then 'lift.name' when 3 then 'lift.depth' else 'wind' end as path, case m when 1 then '300.0' when 2 then priority when 3 then '[object]' else 'undefined' end as a, case m when 1 then '301.0' when 2 then priority || '!' when 3 then '7.0' else 'null' end as b from t where m > 0""",
)
def d21_first_differences(spark, d):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 5
    doc = lambda depth, name, more: F.concat(F.lit('{"price":'), F.col("o_totalprice").cast("string"), F.lit(',"lift":{"name":"'), name, F.lit('","depth":'), depth, F.lit("}"), more, F.lit("}"))
    priority = F.col("o_orderpriority")
    a = doc(F.lit("[200,300]"), priority, F.lit(""))
    b = doc(F.when(m == 1, "[200,301]").when(m == 3, "7").otherwise("[200.0,3e2]"), F.when(m == 2, F.concat(priority, F.lit("!"))).otherwise(priority), F.when(m == 4, ',"wind":null').otherwise(""))
    return paths.first_differences(table(spark, d, "orders").select(k.alias("id"), a.alias("a"), b.alias("b")))
