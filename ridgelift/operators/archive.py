"""An archive of station points by UTC day, read by half-open windows of time that follow a zone's wall clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelift.functions.times import local_instant

DAY = dt.timedelta(days=1)


def day_window(day: Column, zone: str | Column) -> tuple[Column, Column]:
    """From (included) and to (excluded) of a local day (yyyy-MM-dd): the 24 hours from its midnight; null for what is no date."""
    date = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    start = local_instant(date, 0, zone)
    return start, F.timestamp_micros(F.unix_micros(start) + F.lit(86_400_000_000))


def day_step(day: Column, days: int) -> Column:
    """The day so many days away, over the calendar: no change of clocks can skip one."""
    return F.date_format(F.date_add(F.try_to_date(day, "yyyy-MM-dd"), days), "yyyy-MM-dd")


def trailing_window(now: Column, hours: int = 24) -> tuple[Column, Column]:
    return F.timestamp_micros(F.unix_micros(now) - F.lit(hours * 3_600_000_000)), now


def append_points(points: DataFrame, path: str) -> None:
    """Adds points (observed_at, ...) to the folders of their UTC days."""
    points.withColumn("utc_day", F.to_date("observed_at")).write.mode("append").partitionBy("utc_day").parquet(path)


def read_window(spark: SparkSession, path: str, since: dt.datetime, until: dt.datetime) -> DataFrame:
    """Points of [since, until), instants in UTC. Only folders of UTC days that the window meets are listed and read."""
    since, until = (t.astimezone(dt.timezone.utc) if t.tzinfo else t.replace(tzinfo=dt.timezone.utc) for t in (since, until))
    last = (until - dt.timedelta(microseconds=1)).date()
    points = spark.read.parquet(path)
    days = points.where(F.col("utc_day").between(F.lit(since.date()), F.lit(last)))
    return days.where((F.col("observed_at") >= F.lit(since)) & (F.col("observed_at") < F.lit(until))).drop("utc_day")


def in_local_day(points: DataFrame, day: Column, zone: str | Column) -> DataFrame:
    """Points (observed_at, ...) in the window of a local day."""
    start, end = day_window(day, zone)
    at = F.col("observed_at").cast("timestamp")
    return points.where((at >= start) & (at < end))


