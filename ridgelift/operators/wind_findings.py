"""Findings about wind: the day's and the window's strongest, runs above a ceiling, and how the direction turns.

hours: as `findings.prepared` gives them, with levels and the surface's wind_speed_mps, wind_direction_deg, wind_gust_mps. The climb band reaches from
the launch to the usable lift top, with a margin on both sides. A window belongs to the local day of its first hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelift.functions import wind
from ridgelift.functions.numbers import nudge_round

from .findings import DEFAULTS, Thresholds, window_hours
from .sequences import first_wins_max, islands

DAY = ["profile_id", "day"]


def band_max(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """h with `band`: wind_mps, height_m, pressure_hpa and direction_deg of the strongest level in the climb band (the lowest of ties); null without one."""
    inside = F.filter("levels", lambda v: (v["height_m"] >= F.col("launch_m") - t.band_margin_m) & (v["height_m"] <= F.col("usable_lift_top_m") + t.band_margin_m) & v["wind_speed_mps"].isNotNull())
    found = F.array_min(F.transform(inside, lambda v: F.struct((-v["wind_speed_mps"]).alias("s"), v["height_m"].alias("height_m"), v["pressure_hpa"].alias("pressure_hpa"), v["wind_direction_deg"].alias("direction_deg"))))
    b = h.withColumn("_b", found)
    return b.withColumn("band", F.when(F.col("_b").isNotNull(), F.struct((-F.col("_b.s")).alias("wind_mps"), "_b.height_m", "_b.pressure_hpa", "_b.direction_deg"))).drop("_b")


def banded(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """h with `band` in place of the levels, which it may be computed from before hours are put in order."""
    return band_max(h, t).drop("levels")


def _own_day(hours_of_windows: DataFrame) -> DataFrame:
    return hours_of_windows.withColumn("day", F.first("day").over(Window.partitionBy("profile_id", "window_id").orderBy("hour_index")))


def _peaks(prefix: str) -> list[Column]:
    i = F.col("hour_index")
    gust = first_wins_max(F.col("wind_gust_mps"), i, F.struct("wind_gust_mps", "wind_speed_mps", "valid_at"))
    band = first_wins_max(F.col("band.wind_mps"), i, F.struct("band", "valid_at", "hour_index"))
    return [gust.alias(f"_{prefix}g"), band.alias(f"_{prefix}b")]


def _told(prefix: str, name: str, pressure: bool) -> list[Column]:
    g, b = f"_{prefix}g", f"_{prefix}b"
    out = [
        nudge_round(F.col(f"{g}.wind_gust_mps"), 2).alias(f"{name}gust_mps"),
        nudge_round(F.col(f"{g}.wind_speed_mps"), 2).alias(f"{name}gust_mean_mps"),
        F.col(f"{g}.valid_at").alias(f"{name}gust_at"),
        nudge_round(F.col(f"{b}.band.wind_mps"), 2).alias(f"{name}band_mps"),
        nudge_round(F.col(f"{b}.band.direction_deg")).alias(f"{name}band_direction_deg"),
        nudge_round(F.col(f"{b}.band.height_m"), 1).alias(f"{name}band_height_m"),
        F.col(f"{b}.valid_at").alias(f"{name}band_at"),
    ]
    return [*out, F.col(f"{b}.band.pressure_hpa").alias(f"{name}band_pressure_hpa")] if pressure else out


def wind_summaries(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per local day the largest gust and the strongest wind in the band, with the hours around that stay above a share of it; the same within the day's windows (in_window)."""
    x = band_max(h, t).select(*DAY, "hour_index", "valid_at", "after_h", "band", "wind_gust_mps", "wind_speed_mps")
    peak = x.groupBy(*DAY).agg(*_peaks("d"))
    marked = x.join(peak.select(*DAY, F.col("_db.band.wind_mps").alias("_max"), F.col("_db.hour_index").alias("_peak")), DAY)
    on = F.coalesce(F.col("band.wind_mps") >= F.col("_max") * t.persistence_fraction, F.lit(False))
    marked = marked.withColumn("_on", on)
    change = F.col("_on") != F.lag("_on").over(Window.partitionBy(*DAY).orderBy("hour_index"))
    runs = islands(marked.withColumn("_new", change), DAY, ["hour_index"], F.col("_new"), "_run")
    lasting = runs.groupBy(*DAY, "_run").agg(F.sum("after_h").alias("persistence_h"), F.bool_or(F.col("hour_index") == F.col("_peak")).alias("_has")).where("_has").select(*DAY, "persistence_h")
    inside = _own_day(band_max(window_hours(h, t), t)).groupBy(*DAY).agg(*_peaks("w")).withColumn("in_window", F.lit(True))
    out = peak.join(lasting, DAY, "left").join(inside, DAY, "left")
    out = out.select(*DAY, *_told("d", "", True), "persistence_h", F.coalesce("in_window", F.lit(False)).alias("in_window"), *_told("w", "window_", False))
    return out.where(F.col("gust_mps").isNotNull() | F.col("band_mps").isNotNull() | F.col("in_window"))


def wind_exceedances(h: DataFrame, surface_mps: float | None = None, gust_mps: float | None = None, band_mps: float | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """Runs of neighbouring window hours at or above the caller's ceilings, one row a run; without ceilings none. Hours may come as `banded` gives them.

    gust_mps is the ceiling for the kind of gust that the profile declares: pick it by that kind, or leave it out.
    """
    x = window_hours(h, t)
    x = _own_day(x if "band" in x.columns else band_max(x, t))
    asked = [(n, c, v) for n, c, v in (("surfaceWind", surface_mps, "wind_speed_mps"), ("gust", gust_mps, "wind_gust_mps"), ("bandWind", band_mps, "band.wind_mps")) if c is not None]
    kinds = F.array(*[F.struct(F.lit(n).alias("quantity"), F.lit(float(c)).alias("threshold_mps"), F.col(v).alias("v")) for n, c, v in asked]) if asked else F.array().cast("array<struct<quantity:string,threshold_mps:double,v:double>>")
    x = x.withColumn("step_h", F.max("after_h").over(Window.partitionBy(*DAY)))
    x = x.select(*DAY, "hour_index", "valid_at", "after_h", "step_h", F.explode(kinds).alias("k")).select("*", "k.*").where("v >= threshold_mps")
    keys = [*DAY, "quantity", "threshold_mps"]
    apart = F.col("hour_index") != F.lag("hour_index").over(Window.partitionBy(*keys).orderBy("hour_index")) + 1
    runs = islands(x.withColumn("_new", apart), keys, ["hour_index"], F.col("_new"), "run_id")
    return runs.groupBy(*keys, "run_id").agg(F.min("valid_at").alias("start_at"), F.max("valid_at").alias("end_at"), F.sum("after_h").alias("hours"), nudge_round(F.max("v"), 2).alias("peak_mps"), first_wins_max(F.col("v"), F.col("hour_index"), F.col("valid_at")).alias("peak_at"), F.first("step_h").alias("step_h"))


def _mean(u: str, v: str, speed: str, direction: str, t: Thresholds) -> list[Column]:
    m = wind.speed_of(F.col(u), F.col(v))
    return [nudge_round(m, 2).alias(speed), F.when(F.round(m, 9) >= t.direction_floor_mps, nudge_round(F.round(wind.direction_of(F.col(u), F.col(v)), 6))).alias(direction)]


def _surface_of_windows(x: DataFrame) -> DataFrame:
    s, d = F.col("wind_speed_mps"), F.col("wind_direction_deg")
    sample = F.struct(s.alias("s"), d.alias("d"), "valid_at")
    both = s.isNotNull() & d.isNotNull()
    g = x.groupBy("profile_id", "window_id").agg(
        F.first("day").alias("day"),
        F.min_by(sample, "hour_index").alias("a"),
        first_wins_max(F.col("usable_lift_top_m"), F.col("hour_index"), sample).alias("p"),
        F.max_by(sample, "hour_index").alias("b"),
        F.avg(F.when(both, wind.u_of(s, d))).alias("u"),
        F.avg(F.when(both, wind.v_of(s, d))).alias("v"),
        F.count_if(both).alias("samples"),
    )
    return g.where("a.s is not null and p.s is not null and b.s is not null and samples > 0")


def surface_directions(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """profile_id, window_id, day, surface_mps, surface_deg and samples of `wind_directions`, for which hours need no levels."""
    g = _surface_of_windows(_own_day(window_hours(h, t)))
    return g.select("profile_id", "window_id", "day", *_mean("u", "v", "surface_mps", "surface_deg", t), "samples")


def wind_directions(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per window the surface wind at its start, at its highest lift top and at its end, the net veer in (-180, 180], and the vector means of the surface and of the levels
    between launch and lift top. Weak winds have no direction; a window without a speed at one of the three hours, or without any full surface sample, is left out."""
    floor = t.direction_floor_mps
    x = _own_day(window_hours(h, t))
    keys = ["profile_id", "window_id"]
    g = _surface_of_windows(x)
    inside = F.filter("levels", lambda v: (v["height_m"] >= F.col("launch_m")) & (v["height_m"] <= F.col("usable_lift_top_m")) & v["wind_speed_mps"].isNotNull() & v["wind_direction_deg"].isNotNull())
    ls, ld = F.col("l.wind_speed_mps"), F.col("l.wind_direction_deg")
    band = x.where("usable_lift_top_m is not null").select(*keys, F.explode(inside).alias("l")).groupBy(*keys).agg(F.avg(wind.u_of(ls, ld)).alias("bu"), F.avg(wind.v_of(ls, ld)).alias("bv"), F.count("*").alias("band_samples"))
    way = lambda c: F.when((F.col(f"{c}.s") >= floor) & F.col(f"{c}.d").isNotNull(), F.col(f"{c}.d"))
    turn = -wind.signed(way("a") - way("b"))  # in (-180, 180]
    told = [c for n, k in (("start", "a"), ("peak", "p"), ("end", "b")) for c in (nudge_round(F.col(f"{k}.s"), 2).alias(f"{n}_mps"), nudge_round(way(k)).alias(f"{n}_deg"))]
    return g.join(band, keys, "left").select(*keys, "day", *told, F.col("p.valid_at").alias("peak_at"), nudge_round(turn).alias("net_veer_deg"), *_mean("u", "v", "surface_mps", "surface_deg", t), "samples", *_mean("bu", "bv", "band_mps", "band_deg", t), "band_samples")
