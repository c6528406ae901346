"""Findings: typed statements about the days of a forecast profile, one DataFrame per kind.

hours: profile_id, hour_id, valid_at, launch_m, day, local_hour, and the derived quantities; `prepared` adds hour_index and the spans
before and after each hour. Order within a profile is (valid_at, hour_id). Ties go to the first hour, values that are missing or not
finite are never a peak, and rounding takes ties up.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelift.functions import wind
from ridgelift.functions.numbers import nudge_round

from .sequences import first_wins_max, islands, micros


@dataclass(frozen=True)
class Thresholds:
    wstar_min_mps: float = 0.9
    depth_min_m: float = 300.0
    max_gap_hours: float = 0.0
    cloud_cap_margin_m: float = 50.0
    instability_min_cape: float = 100.0
    broken_cap_max_abs_cin: float = 25.0
    broken_cap_min_cape: float = 200.0
    precip_min_mm_hr: float = 0.2
    terrain_min_abs_delta_m: float = 250.0
    band_margin_m: float = 200.0
    persistence_fraction: float = 0.8
    direction_floor_mps: float = 1.0
    min_layer_m: float = 30.0
    endpoint_floor_mps: float = 2.0

    def override(self, **changes: float) -> Thresholds:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"no such thresholds: {sorted(unknown)}")
        return replace(self, **changes)


DEFAULTS = Thresholds()
KEY, ORDER = ["profile_id"], ["valid_at", "hour_id"]


def prepared(hours: DataFrame) -> DataFrame:
    """hours with hour_index, before_h and after_h: whole hours to the neighbours, at least 1, mirrored at the edges; 1 for a single hour."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    gap = lambda a, b: F.greatest(F.lit(1.0), nudge_round((micros(a) - micros(b)) / 3.6e9))
    after, before = gap(F.lead("valid_at").over(w), F.col("valid_at")), gap(F.col("valid_at"), F.lag("valid_at").over(w))
    has_after, has_before = F.lead("valid_at").over(w).isNotNull(), F.lag("valid_at").over(w).isNotNull()
    x = hours.withColumn("hour_index", F.row_number().over(w) - 1).withColumn("_after", F.when(has_after, after)).withColumn("_before", F.when(has_before, before))
    one = F.lit(1.0)
    return x.withColumn("after_h", F.coalesce("_after", "_before", one)).withColumn("before_h", F.coalesce("_before", "_after", one)).drop("_after", "_before")


def lead_hours(reference: Column, at: Column) -> Column:
    return nudge_round((micros(at) - micros(reference)) / 3.6e9, 1)


def clears(t: Thresholds) -> Column:
    top, w = F.col("usable_lift_top_m"), F.col("thermal_velocity_mps")
    return F.coalesce((w >= t.wstar_min_mps) & (top - F.col("launch_m") >= t.depth_min_m), F.lit(False))


def window_hours(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The hours of thermal windows, with window_id: runs that clear both floors, bridged over short gaps whose hours all publish both quantities."""
    w = Window.partitionBy(*KEY).orderBy("hour_index")
    silent = (F.col("usable_lift_top_m").isNull() | F.col("thermal_velocity_mps").isNull()).cast("int")
    marked = h.withColumn("_ok", clears(t)).withColumn("_span", F.sum("after_h").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_silent", F.sum(silent).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ok = marked.where("_ok")
    last = lambda c: F.lag(c).over(w)
    adjacent = F.col("hour_index") == last("hour_index") + 1
    gap = F.coalesce("_span", F.lit(0.0)) - (F.coalesce(last("_span"), F.lit(0.0)) + last("after_h"))
    bridged = adjacent | ((gap <= t.max_gap_hours) & (F.col("_silent") == last("_silent")))
    return islands(ok.withColumn("_new", ~F.coalesce(bridged, F.lit(True))), KEY, ["hour_index"], F.col("_new"), "window_id").drop("_ok", "_span", "_silent", "_new")


def thermal_windows(h: DataFrame, t: Thresholds = DEFAULTS, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row a window, with further aggregates of its hours. The hours are read once."""
    i = F.col("hour_index")
    last = F.lead("hour_index").over(Window.partitionBy(*KEY).orderBy("hour_index")).isNull()
    return window_hours(h.withColumn("_last", last), t).groupBy("profile_id", "window_id").agg(
        F.min_by("day", "hour_index").alias("day"),
        F.min("valid_at").alias("start_at"),
        F.max("valid_at").alias("end_at"),
        F.count("*").alias("n_hours"),
        F.sum("after_h").alias("duration_h"),
        F.max("after_h").alias("step_h"),
        nudge_round(F.max("usable_lift_top_m"), 1).alias("peak_lift_top_m"),
        first_wins_max(F.col("usable_lift_top_m"), i, F.col("valid_at")).alias("peak_at"),
        nudge_round(F.max(F.col("usable_lift_top_m")) - F.first("launch_m"), 1).alias("peak_above_launch_m"),
        nudge_round(F.max("thermal_velocity_mps"), 2).alias("peak_wstar_mps"),
        (F.min("hour_index") == 0).alias("clipped_start"),
        F.bool_or("_last").alias("clipped_end"),
        *also,
    )


def quiet_days(h: DataFrame, t: Thresholds = DEFAULTS, also: tuple[Column, ...] = ()) -> DataFrame:
    """Covered local days that no window touches, with further aggregates of the day's hours. Every hour that clears the floors is in a window and no other hour is, so a day is
    touched if one of its hours clears them: one aggregate, and the hours are read once."""
    i = F.col("hour_index")
    x = h.withColumn("_depth", F.col("usable_lift_top_m") - F.col("launch_m"))
    w, d = F.max("thermal_velocity_mps"), F.max("_depth")
    agg = x.groupBy("profile_id", "day").agg(
        nudge_round(w, 2).alias("peak_wstar_mps"),
        first_wins_max(F.col("thermal_velocity_mps"), i, F.col("valid_at")).alias("peak_wstar_at"),
        nudge_round(d, 1).alias("peak_depth_m"),
        first_wins_max(F.col("_depth"), i, F.col("valid_at")).alias("peak_depth_at"),
        F.coalesce(w < t.wstar_min_mps, F.lit(True)).alias("_fw"),
        F.coalesce(d < t.depth_min_m, F.lit(True)).alias("_fd"),
        F.sum("after_h").alias("covered_h"),
        F.min_by(F.struct("local_hour", "before_h"), "hour_index").alias("_first"),
        F.max_by(F.struct("local_hour", "after_h"), "hour_index").alias("_end"),
        F.bool_or(clears(t)).alias("_touched"),
        *also,
    ).where("not _touched")
    failed = F.concat_ws(",", F.when(F.col("_fw"), "wstar"), F.when(F.col("_fd"), "depth"), F.when(~F.col("_fw") & ~F.col("_fd"), "coincidence"))
    whole = (F.col("_first.local_hour") < F.col("_first.before_h")) & (F.col("_end.local_hour") >= 24 - F.col("_end.after_h"))
    return agg.withColumn("failed", failed).withColumn("truncated", ~whole).drop("_fw", "_fd", "_first", "_end", "_touched")


def lift_ceilings(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Segments of each window with one cause: capped by cloud, or limited by sink."""
    x = window_hours(h, t).where("usable_lift_top_m is not null and cloud_base_m is not null")
    x = x.withColumn("cause", F.when(F.col("cloud_base_m") <= F.col("usable_lift_top_m") + t.cloud_cap_margin_m, "cloudCapped").otherwise("sinkLimited"))
    keys = ["profile_id", "window_id"]
    change = F.col("cause") != F.lag("cause").over(Window.partitionBy(*keys).orderBy("hour_index"))
    x = islands(x.withColumn("_new", change), keys, ["hour_index"], F.col("_new"), "segment_id")
    at_peak = first_wins_max(F.col("usable_lift_top_m"), F.col("hour_index"), F.struct("valid_at", "cloud_base_m"))
    return x.groupBy(*keys, "segment_id", "cause").agg(F.min("valid_at").alias("start_at"), F.max("valid_at").alias("end_at"), F.count("*").alias("n_hours"), nudge_round(F.max("usable_lift_top_m"), 1).alias("peak_top_m"), at_peak.alias("_p")).select("profile_id", "window_id", "segment_id", "cause", "start_at", "end_at", "n_hours", "peak_top_m", F.col("_p.valid_at").alias("peak_at"), nudge_round(F.col("_p.cloud_base_m"), 1).alias("cloud_base_m"))


def cap_timing(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Days with CAPE and CIN in at least two hours: whether and when the cap breaks."""
    x = h.where("cape_jkg is not null and cin_jkg is not null")
    w = Window.partitionBy("profile_id", "day").orderBy("hour_index")
    gap = nudge_round((micros("valid_at") - micros(F.lag("valid_at").over(w))) / 3.6e9)
    x = x.withColumn("_gap", gap).withColumn("_before", F.lag("valid_at").over(w))
    open_ = F.abs("cin_jkg") < t.broken_cap_max_abs_cin
    broken = open_ & (F.col("cape_jkg") > t.broken_cap_min_cape)
    agg = x.groupBy("profile_id", "day").agg(
        F.count("*").alias("_n"),
        F.coalesce(F.bool_and(F.col("_gap") == 1), F.lit(True)).alias("_hourly"),
        F.max("_gap").alias("step_h"),
        F.max("cape_jkg").alias("_cape"),
        first_wins_max(F.col("cape_jkg"), F.col("hour_index"), F.col("valid_at")).alias("_cape_at"),
        F.min_by(F.when(broken, F.struct("valid_at", "_before", "cape_jkg")), F.when(broken, F.col("hour_index"))).alias("_b"),
        F.bool_and(open_).alias("_never"),
    )
    agg = agg.where("_n >= 2")
    weak = F.col("_cape") < t.instability_min_cape
    has = F.col("_b").isNotNull() & ~weak
    return agg.select(
        "profile_id",
        "day",
        F.when(weak, "noInstability").when(has, "capBreaks").when(F.col("_never"), "openButWeak").otherwise("cappedAllDay").alias("verdict"),
        F.when(F.col("_hourly"), "hourly").otherwise("multiHour").alias("cadence"),
        "step_h",
        nudge_round(F.col("_cape")).alias("peak_cape_jkg"),
        F.when(F.col("_cape") > 0, F.col("_cape_at")).alias("peak_cape_at"),
        F.when(has & F.col("_hourly"), F.col("_b.valid_at")).alias("breaks_at"),
        F.when(has & ~F.col("_hourly") & F.col("_b._before").isNull(), F.col("_b.valid_at")).alias("already_open_at"),
        F.when(has & ~F.col("_hourly"), F.col("_b._before")).alias("breaks_after"),
        F.when(has & ~F.col("_hourly") & F.col("_b._before").isNotNull(), F.col("_b.valid_at")).alias("breaks_by"),
        F.when(has, nudge_round(F.col("_b.cape_jkg"))).alias("cape_at_break_jkg"),
    )


def band_shear(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per window day the sharpest shear between neighbouring levels of the climb band (launch to lift top)."""
    x = window_hours(h, t).where("usable_lift_top_m is not null")
    day_of_window = Window.partitionBy("profile_id", "window_id").orderBy("hour_index")
    x = x.withColumn("day", F.first("day").over(day_of_window))
    inside = F.filter("levels", lambda v: (v["height_m"] >= F.col("launch_m")) & (v["height_m"] <= F.col("usable_lift_top_m")) & v["wind_speed_mps"].isNotNull() & v["wind_direction_deg"].isNotNull())
    x = x.withColumn("_in", inside).where(F.size("_in") > 1)
    pairs = F.arrays_zip(F.slice("_in", F.lit(1), F.size("_in") - 1).alias("lo"), F.slice("_in", F.lit(2), F.size("_in") - 1).alias("hi"))
    x = x.select("profile_id", "day", "hour_index", "valid_at", F.size("_in").alias("levels_in_band"), F.posexplode(pairs).alias("i", "p")).select("*", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))
    thick = F.col("hi.height_m") - F.col("lo.height_m")
    u = lambda v: wind.u_of(F.col(f"{v}.wind_speed_mps"), F.col(f"{v}.wind_direction_deg"))
    v = lambda v: wind.v_of(F.col(f"{v}.wind_speed_mps"), F.col(f"{v}.wind_direction_deg"))
    x = x.withColumn("thick_m", thick).where(F.col("thick_m") >= t.min_layer_m).withColumn("shear_mps", wind.shear(u("lo"), v("lo"), u("hi"), v("hi")))
    x = x.withColumn("rate_per_km", F.col("shear_mps") / (F.col("thick_m") / 1000))
    best = first_wins_max(F.col("rate_per_km"), F.struct("hour_index", "i"), F.struct("rate_per_km", "shear_mps", "valid_at", "levels_in_band", "lo", "hi"))
    b = x.groupBy("profile_id", "day").agg(best.alias("b"))
    calm = (F.col("b.lo.wind_speed_mps") < t.endpoint_floor_mps) & (F.col("b.hi.wind_speed_mps") < t.endpoint_floor_mps)
    return b.select("profile_id", "day", nudge_round(F.col("b.rate_per_km"), 2).alias("rate_per_km"), nudge_round(F.col("b.shear_mps"), 2).alias("shear_mps"), F.col("b.valid_at").alias("at"), nudge_round(F.col("b.lo.height_m"), 1).alias("from_m"), nudge_round(F.col("b.hi.height_m"), 1).alias("to_m"), F.col("b.levels_in_band").alias("levels_in_band"), calm.alias("both_under_floor"))


def terrain_mismatch(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    top = F.max("usable_lift_top_m")
    agg = h.groupBy("profile_id").agg(F.first("profile_elevation_m").alias("model_elevation_m"), F.first("launch_m").alias("launch_m"), top.alias("_top"), first_wins_max(F.col("usable_lift_top_m"), F.col("hour_index"), F.col("valid_at")).alias("top_at"))
    delta = F.col("model_elevation_m") - F.col("launch_m")
    return agg.where(F.abs(delta) >= t.terrain_min_abs_delta_m).select("profile_id", "model_elevation_m", "launch_m", nudge_round(delta, 1).alias("delta_m"), F.coalesce(F.col("_top") > F.col("launch_m"), F.lit(False)).alias("ever_reaches_launch"), nudge_round(F.col("_top"), 1).alias("max_top_m"), "top_at")


def data_caveats(h: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Per profile the quantities that no hour publishes, and how often a derived one is missing."""
    gone = [F.when(F.bool_and(F.col(c).isNull()), F.lit(c)) for c in families]
    return h.groupBy("profile_id").agg(F.concat_ws(",", *gone).alias("absent"), F.count_if(F.col("usable_lift_top_m").isNull()).alias("null_lift_hours"), F.max("after_h").alias("widest_step_h"), F.count("*").alias("n_hours"))
