"""Series of a forecast in step order: smoothing, accumulations and averages turned into rates, display days, class shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelift.functions import wind
from ridgelift.functions.numbers import nudge_round

from .findings import DEFAULTS, Thresholds
from .sequences import first_wins_max, islands, micros

HOUR_US = 3_600_000_000


def smooth(h: DataFrame, keys: list[str], order: list[str], at: str, value: str) -> Column:
    """1-2-1 smoothing of original values, only between neighbours exactly an hour away."""
    w = Window.partitionBy(*keys).orderBy(*order)
    p, n = F.lag(value).over(w), F.lead(value).over(w)
    hourly = (micros(at) - micros(F.lag(at).over(w)) == HOUR_US) & (micros(F.lead(at).over(w)) - micros(at) == HOUR_US)
    return F.when(hourly & p.isNotNull() & n.isNotNull() & F.col(value).isNotNull(), (p + F.col(value) * 2 + n) / 4).otherwise(F.col(value))


def three_hourly(value: Column, before: Column, hour: Column, average: bool) -> Column:
    """What the last three hours add to a window of six: its first half stands for itself, its second is de-averaged or differenced."""
    first_half = F.floor((hour - 3) / 6) * 6 == hour - 3
    return F.when(first_half, value).otherwise(value * 2 - before if average else value - before)


def rate(total: Column, before: Column, hour: Column, hour_before: Column) -> Column:
    """Mean rate since the previous scheduled hour of a running total, never below 0."""
    return F.when(total.isNotNull(), F.greatest(F.lit(0.0), total - F.coalesce(before, F.lit(0.0))) / (hour - F.coalesce(hour_before, F.lit(0))))


def percentile_rank(value: Column, point: float) -> Column:
    """Aggregate: percentage below the point, ties counting half."""
    return F.lit(100.0) * (F.count_if(value < point) + F.count_if(value == point) * 0.5) / F.count(value)


def order_quantile(values: Column, q: float) -> Column:
    """The element at floor(q * n) of the sorted values, at most the last."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), F.least(n, F.floor(n * q) + 1).cast("int"))


def at_place(rows: DataFrame, key: str, value: str, place: Callable[[Column], Column]) -> DataFrame:
    """key, and as `value` the element at place(n), from 1, of each key's n sorted values; nulls do not count, keys without values are not listed.

    Values are counted first and the place is found by a running sum over the counts: no array of a key's values is made.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    total = counts.groupBy(key).agg(F.sum("_c").alias("_all"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = place(F.col("_all"))
    found = counts.withColumn("_upto", upto).join(total, key)
    return found.where((F.col("_upto") >= at) & (F.col("_upto") - F.col("_c") < at)).select(key, value)


def class_shares(cells: DataFrame, key: str, code: str, nodata: int = 0) -> DataFrame:
    """Share of each class, without nodata; shares that round to 0 at three digits are left out. Ranked by count, then code."""
    per = cells.where(F.col(code) != nodata).groupBy(key, code).agg(F.count("*").alias("n"))
    total = per.groupBy(key).agg(F.sum("n").alias("_all"))
    share = F.col("n") / F.col("_all")
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), code)
    return per.join(total, key).select(key, code, share.alias("share"), F.row_number().over(order).alias("rank")).where(F.col("share") >= 0.0005)


def display_hours(h: DataFrame, first: int = 7, last: int = 21, least: int = 5) -> DataFrame:
    """Hours of the flying day, on days with enough of them; of a profile without such a day, all hours."""
    inside = F.col("local_hour").between(first, last)
    days = h.where(inside).groupBy("profile_id", "day").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("profile_id", "day", F.lit(True).alias("_ok"))
    some = days.groupBy("profile_id").agg(F.lit(True).alias("_some"))
    x = h.join(days, ["profile_id", "day"], "left").join(some, "profile_id", "left")
    return x.where((inside & F.col("_ok")) | F.col("_some").isNull()).drop("_ok", "_some")


def archive_period(span_minutes: Column, ladder: tuple[int, ...], target: int = 500) -> Column:
    """The finest period that keeps a span within the target number of points, else the coarsest."""
    out = F.lit(max(ladder))
    for p in sorted(ladder, reverse=True):
        out = F.when(span_minutes / p <= target, p).otherwise(out)
    return out


def band_wind(h: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per local day the strongest wind of the climb band (launch - margin to lift top + margin) and how long it persists around that hour."""
    inside = F.filter("levels", lambda v: (v["height_m"] >= F.col("launch_m") - t.band_margin_m) & (v["height_m"] <= F.col("usable_lift_top_m") + t.band_margin_m) & v["wind_speed_mps"].isNotNull())
    strongest = F.array_min(F.transform(inside, lambda v: F.struct((-v["wind_speed_mps"]).alias("s"), v["height_m"].alias("z"))))
    x = h.withColumn("_b", strongest).withColumn("_w", -F.col("_b.s")).withColumn("_z", F.col("_b.z"))
    keys = ["profile_id", "day"]
    peak = x.groupBy(*keys).agg(F.max("_w").alias("_max"), first_wins_max(F.col("_w"), F.col("hour_index"), F.struct("hour_index", "valid_at", "_z")).alias("_p")).where("_max is not null")
    x = x.join(peak, keys)
    x = x.withColumn("_on", F.coalesce(F.col("_w") >= F.col("_max") * t.persistence_fraction, F.lit(False)))
    change = F.col("_on") != F.lag("_on").over(Window.partitionBy(*keys).orderBy("hour_index"))
    runs = islands(x.withColumn("_new", change), keys, ["hour_index"], F.col("_new"), "_run")
    lasting = runs.groupBy(*keys, "_run").agg(F.sum("after_h").alias("persistence_h"), F.bool_or(F.col("hour_index") == F.col("_p.hour_index")).alias("_has")).where("_has")
    return peak.join(lasting, keys).select(*keys, nudge_round(F.col("_max"), 2).alias("wind_mps"), nudge_round(F.col("_p._z"), 1).alias("height_m"), F.col("_p.valid_at").alias("at"), "persistence_h")


def window_band_direction(wh: DataFrame, floor_mps: float = DEFAULTS.direction_floor_mps) -> DataFrame:
    """wh: hours of windows. Vector mean wind of the levels between launch and lift top, per window; weak means have no direction."""
    inside = F.filter("levels", lambda v: (v["height_m"] >= F.col("launch_m")) & (v["height_m"] <= F.col("usable_lift_top_m")) & v["wind_speed_mps"].isNotNull() & v["wind_direction_deg"].isNotNull())
    x = wh.where("usable_lift_top_m is not null").select("profile_id", "window_id", F.explode(inside).alias("v"))
    s, d = F.col("v.wind_speed_mps"), F.col("v.wind_direction_deg")
    g = x.groupBy("profile_id", "window_id").agg(F.avg(wind.u_of(s, d)).alias("u"), F.avg(wind.v_of(s, d)).alias("v"), F.count("*").alias("samples"))
    speed = wind.speed_of(F.col("u"), F.col("v"))
    return g.select("profile_id", "window_id", nudge_round(speed, 2).alias("speed_mps"), F.when(speed >= floor_mps, nudge_round(F.round(wind.direction_of(F.col("u"), F.col("v")), 6))).alias("direction_deg"), "samples")
