"""Ensembles: percentile blocks, circular medians and members censored by the model's top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import wind

POINTS = (10, 25, 50, 75, 90)
CEILING_M = 0.5


def percentile_at(sorted_values: Column, point: float) -> Column:
    """Linear between the two values around rank (n - 1) * point / 100."""
    rank = (F.size(sorted_values) - 1) * point / 100
    low = F.floor(rank)
    a, b = F.element_at(sorted_values, (low + 1).cast("int")), F.element_at(sorted_values, (F.ceil(rank) + 1).cast("int"))
    return F.when(F.size(sorted_values) > 0, F.when(low == F.ceil(rank), a).otherwise(a + (rank - low) * (b - a)))


def block(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """members and p10 to p90 per group. Missing values are no members; without members all percentiles are null. Groups hold one value a member."""
    per = df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    return per.select(*keys, F.size("_v").alias("members"), *[percentile_at(F.col("_v"), p).alias(f"p{p}") for p in POINTS])


def circular_median(df: DataFrame, keys: list[str], deg: str) -> DataFrame:
    """Bearings unwrapped about their vector mean; the median, wrapped again."""
    per = df.where(F.col(deg).isNotNull()).groupBy(*keys).agg(F.collect_list(deg).alias("_b"), F.sum(F.sin(F.col(deg) * wind.RAD)).alias("_s"), F.sum(F.cos(F.col(deg) * wind.RAD)).alias("_c"))
    anchor = F.atan2("_s", "_c") * (180 / 3.141592653589793)
    unwrapped = F.array_sort(F.transform("_b", lambda b: anchor + F.pmod(b - anchor + 180, F.lit(360.0)) - 180))
    return per.select(*keys, wind.normalize(percentile_at(unwrapped, 50)).alias("circular_median_deg"))


def ceiled(value: Column, top: Column, tolerance: float = CEILING_M) -> Column:
    """Aggregate: members whose value reaches the top of their levels."""
    return F.count_if(value.isNotNull() & top.isNotNull() & (value >= top - tolerance))


def p50(value: Column, ensemble_p50: Column) -> Column:
    """The median of an ensemble value, or the plain value; a dropout stays null."""
    return F.coalesce(ensemble_p50, value)
