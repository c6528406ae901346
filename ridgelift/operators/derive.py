"""From source hours and levels to derived hours: admitted levels, cloud base, boundary layer, thermal velocity, usable lift.

Levels of an hour are one array, ascending by height, and every scan over them is a fold of that array: no join and no
shuffle beyond the one that gathers levels to their hour. A model has a few dozen levels, so the arrays are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import air, wind
from ridgelift.functions.numbers import clamp, finite

SINK_MPS = 1.0


def with_levels(hours: DataFrame, levels: DataFrame) -> DataFrame:
    """hours with `levels`: those more than 20 m above the model's ground, ascending (empty if none)."""
    fields = [c for c in levels.columns if c not in ("hour_id", "height_m")]
    per = levels.groupBy("hour_id").agg(F.array_sort(F.collect_list(F.struct("height_m", *fields))).alias("_levels"))
    kept = F.filter("_levels", lambda x: finite(x["height_m"]) & (x["height_m"] > F.col("model_elevation_m") + 20))
    kind = "array<struct<height_m:double," + ",".join(f"{c}:{levels.schema[c].dataType.simpleString()}" for c in fields) + ">>"
    return hours.join(per, "hour_id", "left").withColumn("levels", F.coalesce(kept, F.array().cast(kind))).drop("_levels")


def _state(**fields: Column) -> Column:
    return F.struct(*[c.cast("boolean" if k == "done" else "double").alias(k) for k, c in fields.items()])


def first_saturated(depression: Column, ground: Column, levels: Column) -> Column:
    """Altitude where the dew-point depression first falls to half a degree, interpolated; null if nowhere. Non-finite depressions are skipped."""
    start = _state(done=finite(depression) & (depression <= air.SATURATED), z=F.when(finite(depression), ground), d=F.when(finite(depression), depression), out=F.when(finite(depression) & (depression <= air.SATURATED), ground))

    def step(s: Column, x: Column) -> Column:
        d, z = x["dew_point_depression_c"], x["height_m"]
        hit = d <= air.SATURATED
        between = F.when(s["d"].isNull(), z).otherwise(s["z"] + (s["d"] - air.SATURATED) / (s["d"] - d) * (z - s["z"]))
        return F.when(s["done"] | ~finite(d), s).otherwise(_state(done=hit, z=z, d=d, out=F.when(hit, between)))

    return F.aggregate(levels, start, step, lambda s: s["out"])


def cloud_base(t: Column, depression: Column, ground: Column, levels: Column) -> Column:
    base = ground + air.lcl_agl(t, t - depression)
    base = F.least(base, first_saturated(depression, ground, levels))
    return F.when(finite(base), F.greatest(ground, base)).otherwise(ground)


def boundary_layer_depth(t: Column, ground: Column, levels: Column) -> Column:
    """Where a dry parcel from the ground meets the profile; the column's top if nowhere; 0 without levels."""
    none = F.lit(None)
    start = _state(done=F.lit(False), z=none, t=none, out=F.lit(0.0))

    def step(s: Column, x: Column) -> Column:
        agl = x["height_m"] - ground
        warm = t - agl * air.DRY_LAPSE > x["temperature_c"]
        below = s["z"] - ground
        lapse = (x["temperature_c"] - s["t"]) / (x["height_m"] - s["z"])
        denominator = lapse + air.DRY_LAPSE
        crossing = F.when(s["z"].isNull(), agl).when(F.abs(denominator) < 1e-5, below).otherwise((t - s["t"] + lapse * below) / denominator)
        depth = F.greatest(F.lit(0.0), F.when(warm, agl).otherwise(crossing))
        return F.when(s["done"], s).otherwise(_state(done=~warm, z=x["height_m"], t=x["temperature_c"], out=depth))

    return F.aggregate(levels, start, step, lambda s: s["out"])


def usable_lift_top(ground: Column, bl_top: Column, w: Column, base: Column, levels: Column, sink: float = SINK_MPS) -> Column:
    """The altitude to which the updraught outdoes the sink rate, at most the cloud base; null without usable lift."""
    depth = bl_top - ground
    start = _state(done=F.lit(False), z=depth * 0.2, u=w * 1.97, out=F.least(base, ground + depth))

    def step(s: Column, x: Column) -> Column:
        agl = x["height_m"] - ground
        share = agl / depth
        up = w * 4 * F.cbrt(F.greatest(F.lit(0.0), share)) * (1 - share * 0.8)
        fraction = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(sink) - s["u"]) / (up - s["u"])))
        weak = F.least(base, ground + s["z"] + fraction * (agl - s["z"]))
        at_base = x["height_m"] >= base
        next_state = F.when(at_base, _state(done=F.lit(True), z=s["z"], u=s["u"], out=base)).when(up <= sink, _state(done=F.lit(True), z=s["z"], u=s["u"], out=weak)).otherwise(_state(done=F.lit(False), z=agl, u=up, out=s["out"]))
        return F.when(s["done"] | (agl < depth * 0.25), s).otherwise(next_state)

    lift = F.aggregate(levels, start, step, lambda s: s["out"])
    return F.when(bl_top.isNotNull() & (depth > 0) & (w * 2.02 >= sink), lift)


def derived(hours: DataFrame) -> DataFrame:
    """hours (from `with_levels`) with cloud_base_m, boundary_layer_top_m, thermal_velocity_mps and usable_lift_top_m."""
    t, ground, levels = F.col("temperature_c"), F.col("model_elevation_m"), F.col("levels")
    first_p = F.when(F.size("levels") > 0, F.element_at("levels", 1)["pressure_hpa"])
    step1 = hours.withColumn("cloud_base_m", cloud_base(t, F.col("dew_point_depression_c"), ground, levels)).withColumn("_depth", boundary_layer_depth(t, ground, levels))
    step2 = step1.withColumn("thermal_velocity_mps", air.thermal_velocity(t, F.col("sensible_heat_flux_wm2"), F.col("latent_heat_flux_wm2"), F.col("_depth"), first_p)).withColumn("boundary_layer_top_m", F.when(F.col("_depth") > 0, ground + F.col("_depth")))
    return step2.withColumn("usable_lift_top_m", usable_lift_top(ground, F.col("boundary_layer_top_m"), F.col("thermal_velocity_mps"), F.col("cloud_base_m"), levels)).drop("_depth")


def published_levels(levels: DataFrame) -> DataFrame:
    """Level rows as they are published: dew point instead of depression, sane wind."""
    return levels.select("hour_id", "level_index", "pressure_hpa", "height_m", "temperature_c", (F.col("temperature_c") - F.col("dew_point_depression_c")).alias("dew_point_c"), clamp(F.col("wind_speed_mps"), 0.0, float("inf")).alias("wind_speed_mps"), wind.normalize(F.col("wind_direction_deg")).alias("wind_direction_deg"))


def interpolate(levels: Column, at: Column, field: str, outside: bool = True) -> Column:
    """The field at a height, linear between levels; beyond them the nearest level's value, or null."""
    first, last = F.element_at(levels, 1), F.element_at(levels, -1)
    pairs = F.zip_with(levels, F.slice(levels, 2, F.greatest(F.lit(1), F.size(levels))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = F.element_at(F.filter(pairs, lambda p: p["b"].isNotNull() & (at >= p["a"]["height_m"]) & (at <= p["b"]["height_m"])), 1)
    a, b = hit["a"], hit["b"]
    inner = a[field] + (b[field] - a[field]) * ((at - a["height_m"]) / F.greatest(F.lit(0.001), b["height_m"] - a["height_m"]))
    beyond = lambda x: x[field] if outside else F.lit(None)
    return F.when(F.size(levels) == 0, None).when(at < first["height_m"], beyond(first)).when(at > last["height_m"], beyond(last)).otherwise(F.coalesce(inner, first[field]))
