"""Findings about days: smoke, convection without a stated cap, and what a quiet day's sky was like. hours: as `findings.prepared` gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgelift.functions.numbers import nudge_round

from .findings import DEFAULTS, Thresholds, lead_hours, quiet_days, thermal_windows, window_hours
from .sequences import first_wins_max, micros

DAY = ["profile_id", "day"]


def smoke_impact(h: DataFrame, smoke: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per local day the peak of surface smoke and of its companion, over all hours and over the hours of the day's windows.

    A profile's own smoke (columns smoke_surface_ugm3, smoke_aot of h, if it has them) wins, and the companion is the optical thickness; other profiles take
    the smoke document's hours at the very same instants (smoke: profile_id, valid_at, surface_ugm3, column_mgm2; the last of equal instants by `seq`), and the companion
    is the column. coverage: joined hours of the day's hours.
    """
    own = h.where("smoke_surface_ugm3 is not null and smoke_aot is not null") if "smoke_aot" in h.columns else None
    base = [*DAY, "hour_index", "valid_at"]
    rows = None
    if own is not None:
        rows = own.select(*base, F.lit("profile").alias("source"), F.col("smoke_surface_ugm3").alias("s"), F.col("smoke_aot").alias("c"))
    if smoke is not None:
        last = smoke.groupBy("profile_id", "valid_at").agg(F.max_by(F.struct("surface_ugm3", "column_mgm2"), "seq").alias("x"))
        rest = h if own is None else h.join(own.select("profile_id").distinct(), "profile_id", "left_anti")
        joined = rest.select(*base).join(last, ["profile_id", "valid_at"]).where("x.surface_ugm3 is not null and x.column_mgm2 is not null")
        joined = joined.select(*base, F.lit("joined").alias("source"), F.col("x.surface_ugm3").alias("s"), F.col("x.column_mgm2").alias("c"))
        rows = joined if rows is None else rows.unionByName(joined)
    if rows is None:
        raise ValueError("neither the profile nor a document has smoke")
    own_day = F.first("day").over(Window.partitionBy("profile_id", "window_id").orderBy("hour_index"))
    inside = window_hours(h, t).withColumn("day", own_day).select(*DAY, "hour_index", F.lit(True).alias("_in"))
    x = rows.join(inside, [*DAY, "hour_index"], "left")
    i = F.col("hour_index")
    g = x.groupBy(*DAY, "source").agg(
        F.max("s").alias("_s"),
        first_wins_max(F.col("s"), i, F.col("valid_at")).alias("peak_surface_at"),
        F.max("c").alias("_c"),
        first_wins_max(F.col("c"), i, F.col("valid_at")).alias("peak_companion_at"),
        F.max(F.when(F.col("_in"), F.col("s"))).alias("_ws"),
        F.max(F.when(F.col("_in"), F.col("c"))).alias("_wc"),
        F.count("*").alias("joined_hours"),
    )
    hours = h.groupBy(*DAY).agg(F.count("*").alias("profile_hours"))
    companion = lambda c: F.when(F.col("source") == "profile", nudge_round(F.col(c), 3)).otherwise(nudge_round(F.col(c), 1))
    return g.join(hours, DAY).select(*DAY, "source", nudge_round(F.col("_s"), 1).alias("peak_surface_ugm3"), "peak_surface_at", companion("_c").alias("peak_companion"), "peak_companion_at", nudge_round(F.col("_ws"), 1).alias("window_surface_ugm3"), companion("_wc").alias("window_companion"), "joined_hours", "profile_hours")


def convective_days(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Days of profiles that publish CAPE but no CIN, so that the cap cannot be judged: peak CAPE and rain. Only days with at least two hours, an hour apart each."""
    publishes = h.groupBy("profile_id").agg(F.count("cape_jkg").alias("_cape"), F.count("cin_jkg").alias("_cin")).where("_cape > 0 and _cin = 0").select("profile_id")
    x = h.where("cape_jkg is not null").join(publishes, "profile_id")
    gap = micros("valid_at") - micros(F.lag("valid_at").over(Window.partitionBy(*DAY).orderBy("hour_index")))
    rain, i = F.col("precipitation_mm_hr"), F.col("hour_index")
    wet = rain > t.precip_min_mm_hr
    edge = F.struct("local_hour", "before_h", "after_h")
    g = x.withColumn("_gap", gap).groupBy(*DAY).agg(
        F.count("*").alias("_n"),
        F.coalesce(F.bool_and(F.col("_gap") == 3_600_000_000), F.lit(False)).alias("_hourly"),
        F.max("cape_jkg").alias("_cape"),
        first_wins_max(F.col("cape_jkg"), i, F.col("valid_at")).alias("_cape_at"),
        F.min_by(F.when(wet, F.col("valid_at")), F.when(wet, i)).alias("precip_starts_at"),
        nudge_round(F.max(F.when(wet, rain)), 2).alias("peak_precip_mm_hr"),
        F.when((F.count_if(wet) == 0) & (F.count(rain) > 0), True).alias("no_precip_above_threshold"),
        F.sum("after_h").alias("covered_h"),
        F.min_by(edge, i).alias("a"),
        F.max_by(edge, i).alias("b"),
    )
    ends = thermal_windows(h, t).groupBy(*DAY).agg(F.max("end_at").alias("window_ends_at"))
    whole = (F.col("a.local_hour") < F.col("a.before_h")) & (F.col("b.local_hour") >= 24 - F.col("b.after_h"))
    out = g.where("_n >= 2 and _hourly").join(ends, DAY, "left")
    return out.select(*DAY, nudge_round(F.col("_cape")).alias("peak_cape_jkg"), F.when(F.col("_cape") > 0, F.col("_cape_at")).alias("peak_cape_at"), "precip_starts_at", "peak_precip_mm_hr", "no_precip_above_threshold", "window_ends_at", "covered_h", (~whole).alias("truncated"))


def quiet_day_context(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """`quiet_days` with lead_h and the day's cloud, rain, gust and heat flux. Daytime cloud is the mean of local hours 10 to 16."""
    i, rain = F.col("hour_index"), F.col("precipitation_mm_hr")
    wet = rain > t.precip_min_mm_hr
    also = (
        first_wins_max(F.col("thermal_velocity_mps"), i, F.struct("cloud_cover_pct")).alias("_peak"),
        nudge_round(F.round(F.avg(F.when(F.col("local_hour").between(10, 16), F.col("cloud_cover_pct"))), 6), 1).alias("daytime_cloud_pct"),
        nudge_round(F.max(F.when(wet, rain)), 2).alias("peak_precip_mm_hr"),
        first_wins_max(F.when(wet, rain), i, F.col("valid_at")).alias("peak_precip_at"),
        F.min_by(F.when(wet, F.col("valid_at")), F.when(wet, i)).alias("first_wet_at"),
        F.sum(F.when(wet, F.col("after_h"))).alias("wet_hours"),
        F.when(F.count_if(wet) > 0, F.max("before_h")).alias("precip_step_h"),
        nudge_round(F.max("wind_gust_mps"), 2).alias("max_gust_mps"),
        first_wins_max(F.col("wind_gust_mps"), i, F.col("valid_at")).alias("max_gust_at"),
        nudge_round(F.max("sensible_heat_flux_wm2"), 1).alias("peak_heat_flux_wm2"),
        first_wins_max(F.col("sensible_heat_flux_wm2"), i, F.col("valid_at")).alias("peak_heat_flux_at"),
        F.min("valid_at").alias("_start"),
        F.first("reference_time").alias("_ref"),
    )
    lead = lead_hours(F.col("_ref"), F.coalesce("peak_wstar_at", "peak_depth_at", "_start"))
    return quiet_days(h, t, also).withColumn("lead_h", lead).withColumn("cloud_at_peak_pct", nudge_round(F.col("_peak.cloud_cover_pct"), 1)).drop("_peak", "_start", "_ref")
