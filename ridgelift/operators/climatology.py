"""The climatology cube: sums per (month, slot, sector), which every view aggregates again. Sums, not means, so partial results add up.

Sums of a cell are published with six decimals, as decimal numbers: views add them up exactly, in whatever order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import wind


def _speed() -> Column:
    return F.col("wind_avg_mps")


def _deg() -> Column:
    return F.col("wind_direction_deg")


def _wire(total: Column) -> Column:
    return F.round(total, 6).cast("decimal(28,6)")


def _local(h: DataFrame, slot_minutes: int, offset_minutes: int) -> DataFrame:
    local = F.col("observed_at") + F.expr(f"interval {offset_minutes} minutes")
    return h.withColumn("_local", local).withColumn("month", F.month("_local")).withColumn("slot", F.floor((F.hour("_local") * 60 + F.minute("_local")) / slot_minutes).cast("int"))


def fold(h: DataFrame, sectors: int, slot_minutes: int, offset_minutes: int, bounds: tuple[float, ...] = (2.0, 5.0, 10.0)) -> DataFrame:
    """month, slot, sector (null for calm), n, sums of the components and speeds, counts per speed band, largest gust."""
    blows = wind.blowing(_speed(), _deg())
    b = wind.band(_speed(), bounds)
    return (
        _local(h, slot_minutes, offset_minutes)
        .groupBy("month", "slot", F.when(blows, wind.sector(_deg(), sectors)).alias("sector"))
        .agg(
            F.count("*").alias("n"),
            _wire(F.sum(F.when(blows, wind.u_of(_speed(), _deg())))).alias("u_sum"),
            _wire(F.sum(F.when(blows, wind.v_of(_speed(), _deg())))).alias("v_sum"),
            _wire(F.sum(F.when(blows, _speed()))).alias("speed_sum"),
            *[F.count_if(blows & (b == i)).alias(f"band_{i}") for i in range(len(bounds) + 1)],
            F.max(F.when(blows, F.col("wind_gust_mps"))).alias("max_gust"),
        )
    )


def merge(*cubes: DataFrame) -> DataFrame:
    """Cubes of several years or batches as one."""
    whole = cubes[0]
    for c in cubes[1:]:
        whole = whole.unionByName(c)
    keys = ["month", "slot", "sector"]
    return whole.groupBy(*keys).agg(*[(F.max if c == "max_gust" else F.sum)(c).alias(c) for c in whole.columns if c not in keys])


def rose(cube: DataFrame, sectors: int, months: tuple[int, ...] | None = None, slots: tuple[int, ...] | None = None) -> DataFrame:
    chosen = cube
    for name, keep in (("month", months), ("slot", slots)):
        chosen = chosen if keep is None else chosen.where(F.col(name).isin(*keep))
    total = chosen.agg(F.sum(F.when(F.col("sector").isNotNull(), F.col("n"))).alias("_blowing"))
    per = chosen.where("sector is not null").groupBy("sector").agg(F.sum("n").alias("_n"), F.sum("speed_sum").alias("_s"), F.max("max_gust").alias("max_gust_mps"))
    n = F.coalesce("_n", F.lit(0))
    spine = cube.sparkSession.range(sectors).select(F.col("id").cast("int").alias("sector"))
    return spine.join(per, "sector", "left").crossJoin(F.broadcast(total)).select("sector", n.alias("n"), F.when(F.coalesce("_blowing", F.lit(0)) == 0, 0.0).otherwise(n / F.col("_blowing")).alias("frequency"), (F.col("_s").cast("double") / F.col("_n")).alias("mean_speed_mps"), "max_gust_mps")


def pattern(cube: DataFrame, slot_minutes: int) -> DataFrame:
    n = F.sum("n")
    per = cube.groupBy("slot").agg(n.alias("n"), (F.coalesce(F.sum("u_sum").cast("double"), F.lit(0.0)) / n).alias("u"), (F.coalesce(F.sum("v_sum").cast("double"), F.lit(0.0)) / n).alias("v"))
    spine = cube.sparkSession.range(1440 // slot_minutes).select(F.col("id").cast("int").alias("slot"))
    s = wind.speed_of(F.col("u"), F.col("v"))
    return spine.join(per, "slot", "left").select((F.col("slot") * slot_minutes).cast("int").alias("start_minute"), F.coalesce("n", F.lit(0)).alias("sample_count"), F.coalesce(s, F.lit(0.0)).alias("speed_mps"), F.when(s >= wind.CALM_MPS, wind.direction_of(F.col("u"), F.col("v"))).alias("direction_deg"))


def covered_slots(h: DataFrame, slot_minutes: int, offset_minutes: int) -> DataFrame:
    """Distinct (month, day, slot) per local year. Distinct first, so the counts combine before the shuffle."""
    local = _local(h, slot_minutes, offset_minutes)
    per = local.groupBy(F.year("_local").alias("year"), "month", F.day("_local").alias("day"), "slot").agg(F.count("*").alias("n"))
    return per.groupBy("year").agg(F.count("*").alias("covered_slots"), F.sum("n").alias("n"))


def year_cubes(h: DataFrame, sectors: int, slot_minutes: int, offset_minutes: int) -> DataFrame:
    """The cube of every local year, with `year`: one pass for all years. Years before the first with a point have no rows, so leading empty years are absent."""
    local = _local(h, slot_minutes, offset_minutes)
    blows = wind.blowing(_speed(), _deg())
    return local.groupBy(F.year("_local").alias("year"), "month", "slot", F.when(blows, wind.sector(_deg(), sectors)).alias("sector")).agg(
        F.count("*").alias("n"),
        _wire(F.sum(F.when(blows, wind.u_of(_speed(), _deg())))).alias("u_sum"),
        _wire(F.sum(F.when(blows, wind.v_of(_speed(), _deg())))).alias("v_sum"),
        _wire(F.sum(F.when(blows, _speed()))).alias("speed_sum"),
        F.max(F.when(blows, F.col("wind_gust_mps"))).alias("max_gust"),
    )


def coverage_ledger(h: DataFrame, slot_minutes: int, offset_minutes: int, period_minutes: int) -> DataFrame:
    """Per (month, slot): years, points, points expected over those years, and their ratio, which is null if any year of the record lacks the pair.

    A year expects as many points in a slot of a month as its days there hold periods.
    """
    local = _local(h, slot_minutes, offset_minutes)
    per = local.groupBy(F.year("_local").alias("year"), "month", "slot").agg(F.count("*").alias("n"))
    days = F.day(F.last_day(F.make_date("year", "month", F.lit(1))))
    per = per.withColumn("expected", days * F.lit(slot_minutes) / F.lit(period_minutes))
    years = per.agg(F.count_distinct("year").alias("_years"))  # one row
    whole = per.groupBy("month", "slot").agg(F.count("*").alias("years"), F.sum("n").alias("n"), F.sum("expected").alias("expected_count"))
    return whole.crossJoin(F.broadcast(years)).withColumn("ratio", F.when(F.col("years") == F.col("_years"), F.col("n") / F.col("expected_count"))).drop("_years")


def favorable_share(cube: DataFrame, sectors: int, arcs: tuple[tuple[float, float], ...]) -> DataFrame:
    """Arcs are judged at the sectors' centres."""
    centre = F.col("sector") * (360.0 / sectors)
    inside = F.lit(False)
    for a, b in arcs:
        inside = inside | wind.in_arc(centre, a, b)
    return cube.agg((F.sum(F.when(inside, F.col("n"))) / F.nullif(F.sum(F.when(F.col("sector").isNotNull(), F.col("n"))), F.lit(0))).alias("share"))
