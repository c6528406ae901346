"""Forecast hours as readers ask for them: parts of a document, complete hours, accumulations as rates, and samples against the hour grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelift.functions import times

from .sequences import micros

#: Slack of a comparison of two published heights, and of two packed gusts.
CAP_TOLERANCE_M, GUST_SLACK_MPS = 1.0, 0.1


def project(h: DataFrame, keep: list[str] | None = None, level_fields: list[str] | None = None, drop_levels: bool = False, day: str | None = None, zone: str | None = None) -> DataFrame:
    """h without the hours of other local days and without the fields that are not kept; levels with fewer fields or none."""
    if day is not None:
        if zone is None:
            raise ValueError("a local day needs a time zone")
        h = h.where(times.local_day(F.col("valid_at"), zone) == day)
    if drop_levels:
        h = h.withColumn("levels", F.slice("levels", 1, 0))
    elif level_fields is not None:
        h = h.withColumn("levels", F.transform("levels", lambda v: F.struct(*[v[f].alias(f) for f in level_fields])))
    return h if keep is None else h.select(*keep)


def at_indices(h: DataFrame, indices: list[int]) -> DataFrame:
    return h.where(F.col("hour_index").isin(*indices))


def at_instants(h: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hours at the instants asked for (profile_id, valid_at); instants without an hour give none."""
    return h.join(wanted.select("profile_id", "valid_at").distinct(), ["profile_id", "valid_at"], "left_semi")


def resolved(h: DataFrame, level_core: tuple[str, ...], core: tuple[str, ...]) -> DataFrame:
    """Hours that state every core measure, with the levels that do, lowest first."""
    whole = lambda v: F.forall(F.array(*[v[c].isNotNull() for c in level_core]), lambda ok: ok)
    first = F.transform(F.filter("levels", whole), lambda v: F.struct(v["height_m"].alias("_h"), v.alias("v")))
    return h.dropna(subset=list(core)).withColumn("levels", F.transform(F.array_sort(first), lambda x: x["v"]))


def band(p25: Column, p75: Column) -> Column:
    return F.when(p25.isNotNull() & p75.isNotNull(), F.struct(p25.alias("p25"), p75.alias("p75")))


def leading_step(h: DataFrame) -> DataFrame:
    """Per profile the hours between its first two hours, rounded, at least 1; 1 for a single hour."""
    first = F.min_by("valid_at", "hour_index")
    second = F.max(F.when(F.col("hour_index") == 1, F.col("valid_at")))
    gap = F.floor((micros(second) - micros(first)) / 3.6e9 + 0.5)
    return h.groupBy("profile_id").agg(F.greatest(F.lit(1.0), F.coalesce(gap.cast("double"), F.lit(1.0))).alias("step_h"))


def first_steps(h: DataFrame, most: int) -> DataFrame:
    return h.where(F.col("hour_index") < most)


def cloud_capped(top: Column, base: Column) -> Column:
    """Whether the climb ends in cloud; no answer without a lift top."""
    return F.when(top.isNotNull(), top >= base - CAP_TOLERANCE_M)


def cape_capped(cape: Column, cin: Column, capped: float) -> Column:
    return F.when(cape.isNotNull() & cin.isNotNull(), cin <= capped)


def checked_gust(hour_max: Column, instant: Column) -> Column:
    """The hour's largest gust; a job fails where an instantaneous one is clearly larger, for then the source means something else."""
    broken = hour_max < instant - GUST_SLACK_MPS
    said = F.format_string("hour-max gust %.2f m/s < instantaneous %.2f m/s", hour_max, instant)
    return F.when(broken, F.raise_error(said).cast("double")).otherwise(hour_max)


def bucket_rates(h: DataFrame, keys: list[str], lead: str, total: str, reset_h: Column, hourly_through: int) -> DataFrame:
    """rate per hour of an accumulation that starts anew every reset_h hours: the total less the hour before's in the same bucket; beyond the hourly part totals span three hours."""
    start = F.floor((F.col(lead) - 1) / reset_h) * reset_h
    w = Window.partitionBy(*keys, F.when(F.col(lead) <= hourly_through, start)).orderBy(lead)
    before = F.when(F.lag(lead).over(w) == F.col(lead) - 1, F.lag(total).over(w))
    fresh = F.col(lead) - start == 1
    hourly = F.when(fresh, F.col(total)).otherwise(F.col(total) - before)
    return h.withColumn("rate", F.when(F.col(lead) > hourly_through, F.col(total) / 3).otherwise(hourly))


def flux_rates(h: DataFrame, keys: list[str], lead: str, total: str) -> DataFrame:
    """Mean flux (per second) since the hour before in the schedule of an ever-growing total; null at the first. May be negative."""
    w = Window.partitionBy(*keys).orderBy(lead)
    return h.withColumn("flux", (F.col(total) - F.lag(total).over(w)) / ((F.col(lead) - F.lag(lead).over(w)) * 3600.0))


def on_hour_columns(samples: DataFrame, hours: DataFrame, gap_minutes: float, line_quality: int) -> DataFrame:
    """samples (profile_id, at, value, quality) with their place on the columns of hours (profile_id, hour_index, valid_at), a fraction of a column between two.

    Samples more than half a step outside the grid are left out. `degraded` samples are beyond the quality of the line; `breaks` marks a line sample that follows its
    predecessor after more than the gap. Samples and hours are sorted together, so no pairs are formed.
    """
    w = Window.partitionBy("profile_id").orderBy("hour_index")
    edges = hours.select("profile_id", "hour_index", micros("valid_at").alias("t"), micros(F.lead("valid_at").over(w)).alias("next"), (micros("valid_at") - micros(F.lag("valid_at").over(w))).alias("back"))
    finite = samples.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    both = edges.select("profile_id", "t", F.struct("hour_index", "t", "next", "back").alias("e")).unionByName(finite.select("profile_id", micros("at").alias("t"), F.struct("at", "value", "quality").alias("s")), allowMissingColumns=True)
    order = Window.partitionBy("profile_id").orderBy("t", F.col("s").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = edges.where("hour_index = 0").select("profile_id", F.col("t").alias("_t0"), F.coalesce(F.col("next") - F.col("t"), F.lit(3_600_000_000)).alias("_step0"))
    x = both.withColumn("e", F.last("e", ignorenulls=True).over(order)).where("s is not null").join(first, "profile_id")
    hour, last_step = F.lit(3_600_000_000), F.coalesce("e.back", F.lit(3_600_000_000))
    t = F.col("t")
    before = F.when(t >= F.col("_t0") - F.col("_step0") / 2, (t - F.col("_t0")) / F.col("_step0"))
    after = F.when(F.col("e.next").isNotNull(), F.col("e.hour_index") + (t - F.col("e.t")) / (F.col("e.next") - F.col("e.t"))).when(t <= F.col("e.t") + F.coalesce(last_step, hour) / 2, F.col("e.hour_index") + (t - F.col("e.t")) / last_step)
    x = x.withColumn("column_offset", F.when(F.col("e").isNull(), before).otherwise(after)).where("column_offset is not null")
    x = x.select("profile_id", "s.at", "s.value", "s.quality", "column_offset", (F.col("s.quality") > line_quality).alias("degraded"))
    line = Window.partitionBy("profile_id", "degraded").orderBy("at")
    return x.withColumn("breaks", ~F.col("degraded") & F.coalesce(micros("at") - micros(F.lag("at").over(line)) > gap_minutes * 60_000_000, F.lit(False)))


def newest_complete(cycles: DataFrame, now: Column) -> DataFrame:
    """Per model the newest cycle that is complete and not in the future, of today's and yesterday's. cycles: model, reference_time, complete."""
    day = F.date_trunc("day", now)
    seen = cycles.where(F.col("complete") & (F.col("reference_time") <= now) & (F.col("reference_time") >= day - F.expr("interval 1 day")))
    return seen.groupBy("model").agg(F.max("reference_time").alias("reference_time"))


def pressure_ticks(levels: DataFrame, floor_m: Column, gap_m: float = 80.0) -> DataFrame:
    """levels: profile_id, pressure_hpa, height_m. Per pressure the median height, and the floor (null pressure); ticks less than the gap above the next lower entry are left out."""
    per = levels.groupBy("profile_id", "pressure_hpa").agg(F.floor(F.percentile("height_m", 0.5) + 0.5).cast("double").alias("altitude_m"))
    ground = levels.select("profile_id", F.floor(floor_m + 0.5).cast("double").alias("altitude_m"), F.lit(None).cast("double").alias("pressure_hpa")).distinct()
    w = Window.partitionBy("profile_id").orderBy("altitude_m", F.col("pressure_hpa").isNotNull(), F.col("pressure_hpa").desc())
    x = per.unionByName(ground).withColumn("_gap", F.col("altitude_m") - F.lag("altitude_m").over(w))
    return x.where(F.col("_gap").isNull() | (F.col("_gap") >= gap_m)).drop("_gap")


def altitude_top(floor_m: Column, launch_m: Column, *candidates: Column) -> Column:
    """The top of an altitude axis: at least 800 m above the floor, and 4 % above everything drawn."""
    return F.greatest(floor_m + 800, F.coalesce(launch_m, floor_m), *[F.coalesce(c, floor_m) for c in candidates]) * 1.04
