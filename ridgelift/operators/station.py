"""Views of station history: station_id, seq, observed_at and the measures of one period each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgelift.functions import wind
from ridgelift.functions.numbers import nudge_round

from .sequences import first_wins_max, islands, micros, seconds_since_previous

#: A gap is a distance of more than so many periods.
GAP_FACTOR = 2.5
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}
KEYS, ORDER = ["station_id"], ["observed_at", "seq"]


def _speed() -> Column:
    return F.col("wind_avg_mps")


def _deg() -> Column:
    return F.col("wind_direction_deg")


def _at() -> Column:
    return F.col("observed_at")


def local_minute(at: Column, offset_minutes: int) -> Column:
    return F.pmod(F.floor(micros(at) / 6e7) + offset_minutes, F.lit(1440))


def in_months(at: Column, months: tuple[int, ...], offset_minutes: int = 0) -> Column:
    return F.month(at + F.expr(f"interval {offset_minutes} minutes")).isin(*months)


def in_time_of_day(at: Column, start: int, end: int, offset_minutes: int = 0) -> Column:
    """Half-open; wraps midnight when it ends before it starts."""
    m = local_minute(at, offset_minutes)
    return (m >= start) | (m < end) if start > end else (m >= start) & (m < end)


def trailing(h: DataFrame, hours: int) -> DataFrame:
    """The last hours before each station's newest point. The newest instants are one row a station, joined back."""
    last = h.groupBy("station_id").agg(F.max("observed_at").alias("_last"))
    return h.join(last, "station_id").where(F.col("observed_at") >= F.col("_last") - F.expr(f"interval {hours} hours")).drop("_last")


def mean_direction(h: DataFrame) -> DataFrame:
    return h.groupBy("station_id").agg(wind.circular_mean(_deg(), wind.blowing(_speed(), _deg())).alias("mean_direction_deg"))


def vector_mean(h: DataFrame) -> DataFrame:
    s, deg = wind.vector_mean(_speed(), _deg())
    return h.groupBy("station_id").agg(s.alias("speed_mps"), deg.alias("direction_deg"))


def wind_rose(h: DataFrame, sectors: int, bounds: tuple[float, ...]) -> DataFrame:
    """One row a sector, empty ones too. Two small aggregates of one scan; the second has one row."""
    total = h.agg(F.count("*").alias("sample_count"), F.count_if(wind.blowing(_speed(), _deg())).alias("_blowing"))
    b = wind.band(_speed(), bounds)
    per = (
        h.where(wind.blowing(_speed(), _deg()))
        .groupBy(wind.sector(_deg(), sectors).alias("sector"))
        .agg(F.count("*").alias("_n"), F.avg(_speed()).alias("_mean"), F.max("wind_gust_mps").alias("_gust"), *[F.count_if(b == i).alias(f"_b{i}") for i in range(len(bounds) + 1)])
    )
    spine = h.sparkSession.range(sectors).select(F.col("id").cast("int").alias("sector"))
    n = F.coalesce("_n", F.lit(0))
    return (
        spine.join(per, "sector", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "sector",
            (F.col("sector") * (360.0 / sectors)).alias("bearing_deg"),
            n.alias("n"),
            F.round(F.when(F.col("_blowing") == 0, 0.0).otherwise(n / F.col("_blowing")), 6).alias("frequency"),
            F.round("_mean", 6).alias("mean_speed_mps"),
            F.round("_gust", 6).alias("max_gust_mps"),
            *[F.coalesce(f"_b{i}", F.lit(0)).alias(f"band_{i}") for i in range(len(bounds) + 1)],
            "sample_count",
            F.round(F.when(F.col("sample_count") == 0, 0.0).otherwise((F.col("sample_count") - F.col("_blowing")) / F.col("sample_count")), 6).alias("calm_fraction"),
        )
    )


def period_summary(h: DataFrame, period_minutes: int) -> DataFrame:
    order = F.struct("observed_at", "seq")
    return h.groupBy("station_id").agg(
        F.avg(_speed()).alias("wind_avg_mps"),
        F.max("wind_gust_mps").alias("peak_gust_mps"),
        first_wins_max(F.col("wind_gust_mps"), order, _at()).alias("peak_gust_at"),
        F.min("wind_lull_mps").alias("lowest_lull_mps"),
        F.max("observed_at").alias("period_ended_at"),
        F.max("temperature_c").alias("temperature_high_c"),
        first_wins_max(F.col("temperature_c"), order, _at()).alias("temperature_high_at"),
        F.min("temperature_c").alias("temperature_low_c"),
        first_wins_max(F.col("temperature_c"), order, _at(), smallest=True).alias("temperature_low_at"),
        (F.sum(_speed()) * period_minutes * 60 / 1000).alias("wind_run_km"),
    )


def samples_summary(h: DataFrame) -> DataFrame:
    return h.groupBy("station_id").agg(
        F.count("*").alias("n"),
        F.max_by(_speed(), F.struct("observed_at", "seq")).alias("latest_mps"),
        F.max(_speed()).alias("peak_mps"),
        F.avg(_speed()).alias("mean_mps"),
        ((micros(F.max("observed_at")) - micros(F.min("observed_at"))) / 6e7).alias("span_minutes"),
    )


def daily_pattern(h: DataFrame, slot_minutes: int, offset_minutes: int) -> DataFrame:
    if slot_minutes <= 0 or 1440 % slot_minutes:
        raise ValueError(f"slots of {slot_minutes} minutes do not divide a day")
    s, deg = wind.vector_mean(_speed(), _deg())
    per = h.groupBy(F.floor(local_minute(_at(), offset_minutes) / slot_minutes).alias("slot")).agg(F.count("*").alias("n"), s.alias("s"), deg.alias("direction_deg"))
    spine = h.sparkSession.range(1440 // slot_minutes).withColumnRenamed("id", "slot")
    return spine.join(per, "slot", "left").select((F.col("slot") * slot_minutes).cast("int").alias("start_minute"), F.coalesce("n", F.lit(0)).alias("sample_count"), F.coalesce("s", F.lit(0.0)).alias("speed_mps"), "direction_deg")


def favorable_share(h: DataFrame, arcs: tuple[tuple[float, float], ...]) -> DataFrame:
    inside = F.lit(False)
    for a, b in arcs:
        inside = inside | wind.in_arc(_deg(), a, b)
    blows = wind.blowing(_speed(), _deg())
    return h.groupBy("station_id").agg((F.count_if(blows & inside) / F.nullif(F.count_if(blows), F.lit(0))).alias("share"))


def coverage(h: DataFrame, period_minutes: int, start: str, end: str) -> DataFrame:
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    expected = F.greatest(F.lit(0), F.floor((micros(b) - micros(a)) / (period_minutes * 6e7)))
    n = F.count_if((_at() >= a) & (_at() < b))
    return h.groupBy("station_id").agg(n.alias("actual_count"), F.first(expected).alias("expected_count"), F.first(expected).alias("_e")).withColumn("ratio", F.when(F.col("_e") == 0, 0.0).otherwise(F.col("actual_count") / F.col("_e"))).drop("_e")


def _is_gap(period_minutes: int) -> Column:
    return seconds_since_previous("observed_at", KEYS, ORDER) > period_minutes * 60 * GAP_FACTOR


def gaps(h: DataFrame, period_minutes: int) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    return h.select("station_id", F.lag("observed_at").over(w).alias("from_at"), F.col("observed_at").alias("to_at"), _is_gap(period_minutes).alias("_gap")).where("_gap").drop("_gap")


def runs(h: DataFrame, period_minutes: int) -> DataFrame:
    return islands(h.withColumn("_gap", _is_gap(period_minutes)), KEYS, ORDER, F.col("_gap")).drop("_gap")


def _runs_of(h: DataFrame, period_minutes: int, has: Column) -> DataFrame:
    """Runs that end at gaps and at rows without a value; such a row still counts as the previous one."""
    marked = h.withColumn("_gap", _is_gap(period_minutes)).withColumn("_has", has)
    return islands(marked, KEYS, ORDER, ~F.col("_has") | F.coalesce("_gap", F.lit(False))).where("_has").drop("_gap", "_has")


def trend_runs(h: DataFrame, series: str, period_minutes: int) -> DataFrame:
    return _runs_of(h, period_minutes, F.col(series).isNotNull())


def band_strips(h: DataFrame, period_minutes: int) -> DataFrame:
    return _runs_of(h, period_minutes, F.col("wind_gust_mps").isNotNull() & F.col("wind_lull_mps").isNotNull())


def pressure_tendency(h: DataFrame, window_hours: int = 3, threshold: float = 1.5) -> DataFrame:
    """Change against the point nearest the window's start (the first of ties); null if the record covers under 60 %."""
    c = h.where("sea_level_pressure_hpa is not null")
    last = c.groupBy("station_id").agg(F.max(F.struct("observed_at", "seq", F.col("sea_level_pressure_hpa").alias("p"))).alias("l"))
    back = window_hours * 3_600_000_000
    far = F.abs(micros("observed_at") - (micros("l.observed_at") - back))
    ref = c.join(last, "station_id").groupBy("station_id").agg(F.first("l").alias("l"), F.min_by(F.struct("observed_at", F.col("sea_level_pressure_hpa").alias("p")), F.struct(far, "observed_at", "seq")).alias("r"))
    covers = micros("l.observed_at") - micros("r.observed_at") >= back * 0.6
    delta = F.when(covers, F.col("l.p") - F.col("r.p"))
    out = h.select("station_id").distinct().join(ref, "station_id", "left").where("l is not null").select("station_id", delta.alias("delta_hpa"))
    d = F.col("delta_hpa")
    return out.withColumn("tendency", F.when(d >= threshold, "rising").when(d <= -threshold, "falling").when(d.isNotNull(), "steady"))


def thin_vanes(h: DataFrame, target: int) -> DataFrame:
    w = Window.partitionBy(*KEYS)
    step = F.greatest(F.lit(1), nudge_round(F.count("*").over(w) / float(target)).cast("long"))
    numbered = h.withColumn("_i", F.row_number().over(w.orderBy(*ORDER)) - 1).withColumn("_step", step)
    at = micros("observed_at")
    return numbered.groupBy("station_id", F.floor(F.col("_i") / F.col("_step")).alias("vane")).agg(
        F.avg(_speed()).alias("wind_avg_mps"),
        wind.circular_mean(_deg(), wind.blowing(_speed(), _deg())).alias("wind_direction_deg"),
        F.min("_i").cast("long").alias("start_index"),
        ((F.min(at) + (F.max(at) - F.min(at)) / 2) / 1e6).alias("mid_s"),
    )


def latest_value(h: DataFrame, sensor: str, lookback_minutes: int) -> DataFrame:
    last = h.groupBy("station_id").agg(F.max("observed_at").alias("_last"))
    fresh = F.col(sensor).isNotNull() & (F.col("observed_at") >= F.col("_last") - F.expr(f"interval {lookback_minutes} minutes"))
    return h.join(last, "station_id").groupBy("station_id").agg(F.max_by(F.when(fresh, F.col(sensor)), F.when(fresh, F.struct("observed_at", "seq"))).alias(sensor))


def nearest_point(h: DataFrame, cursors: DataFrame) -> DataFrame:
    """cursors: station_id, at: one instant a station. The point nearest to it, the first of ties."""
    far = F.abs(micros("observed_at") - micros("at"))
    return h.join(cursors.select("station_id", "at"), "station_id").groupBy("station_id").agg(F.min_by(F.struct("seq", "observed_at"), F.struct(far, "observed_at", "seq")).alias("p")).select("station_id", "p.*")


def all_calm(h: DataFrame) -> DataFrame:
    """Whether every point of a station is calm, by its gust or, without one, its mean."""
    return h.groupBy("station_id").agg(F.bool_and(F.coalesce("wind_gust_mps", "wind_avg_mps") < wind.CALM_MPS).alias("calm"))


def graded_segments(h: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """Segments between neighbouring points with the speed band of their mean."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    before = F.lag(_speed()).over(w)
    x = h.select("station_id", "seq", "observed_at", F.lag("observed_at").over(w).alias("from_at"), wind.band((before + _speed()) / 2, bounds).alias("band"))
    return x.where("from_at is not null")


def value_scale(h: DataFrame, value: str, padding: float) -> DataFrame:
    """Lowest and highest value of a station with padding; 0 stands for both if there is none."""
    low, high = F.coalesce(F.min(value), F.lit(0.0)), F.coalesce(F.max(value), F.lit(0.0))
    return h.groupBy("station_id").agg((low - padding).alias("low"), (high + padding).alias("high"))


def compare_window(h: DataFrame, hours: int, days_back: int) -> DataFrame:
    """Points shown (the last hours) and points of the same span some days before.

    The span runs from the first shown point to the last, both moved back. It counts only if points reach both of its ends within
    `GAP_FACTOR` average periods of the whole record; else then_n is null, never a short trace. Three small aggregates by station.
    """
    back = days_back * 86_400_000_000
    facts = h.groupBy("station_id").agg(F.min("observed_at").alias("_first"), F.max("observed_at").alias("_last"), F.count("*").alias("_n"))
    is_shown = _at() >= F.col("_last") - F.expr(f"interval {hours} hours")
    shown = h.join(facts, "station_id").groupBy("station_id", "_first", "_last", "_n").agg(F.count_if(is_shown).alias("now_n"), F.min(F.when(is_shown, _at())).alias("_shown"))
    start, end = micros("_shown") - back, micros("_last") - back
    inside = micros("observed_at").between(start, end)
    keys = ["station_id", "_first", "_last", "_n", "_shown", "now_n"]
    found = h.join(shown, "station_id").groupBy(*keys).agg(F.count_if(inside).alias("_c"), F.min(F.when(inside, micros("observed_at"))).alias("_a"), F.max(F.when(inside, micros("observed_at"))).alias("_b"))
    slack = F.when(F.col("_n") > 1, (micros("_last") - micros("_first")) / (F.col("_n") - 1) * GAP_FACTOR).otherwise(0.0)
    reaches = (F.col("_c") > 0) & (F.col("_a") - start <= slack) & (end - F.col("_b") <= slack)
    return found.select("station_id", "now_n", F.when(reaches, F.col("_c")).alias("then_n"))
