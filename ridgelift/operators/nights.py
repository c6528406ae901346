"""Nights at stations: from sunset to the next sunrise, by the sun. Without coordinates or under a polar sky there is no night."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions.sun import sun_event

from .sequences import micros


def _event(day: Column, lat: Column, lon: Column, sunset: bool) -> Column:
    """Microseconds since 1970 of the sunrise or sunset of a UTC day, in whole milliseconds."""
    ms = F.unix_millis(day.cast("timestamp")) + F.round(sun_event(day, lat, lon, sunset) * 3_600_000).cast("bigint")
    return ms * 1000


def nights(h: DataFrame, places: DataFrame) -> DataFrame:
    """Night intervals of each station's series, cut at its first and last point. h: station_id, observed_at; places: station_id, latitude, longitude. Series of fewer than two points have none."""
    span = h.groupBy("station_id").agg(F.min("observed_at").alias("a"), F.max("observed_at").alias("b"), F.count("*").alias("n")).where("n >= 2")
    x = span.join(places.dropna(subset=["latitude", "longitude"]), "station_id")
    first, last = F.date_sub(F.to_date("a"), 1), F.to_date("b")
    x = x.withColumn("day", F.explode(F.sequence(first, last)))
    lat, lon = F.col("latitude"), F.col("longitude")
    dark_from = F.greatest(_event(F.col("day"), lat, lon, True), micros("a"))
    dark_to = F.least(_event(F.date_add("day", 1), lat, lon, False), micros("b"))
    known = _event(F.col("day"), lat, lon, True).isNotNull() & _event(F.date_add("day", 1), lat, lon, False).isNotNull()
    out = x.where(known).select("station_id", "day", dark_from.alias("f"), dark_to.alias("t")).where("f < t")
    return out.select("station_id", "day", F.timestamp_micros("f").alias("from_at"), F.timestamp_micros("t").alias("to_at"))


def last_night_low(h: DataFrame, places: DataFrame, now: Column) -> DataFrame:
    """The lowest temperature between the latest sunrise before `now` and the sunset before it; stations without such a night or a temperature in it are left out.

    places: station_id, latitude, longitude: the nights are one row a station, so the series is read once.
    """
    days = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.date_sub(F.to_date(now), i))
    lat, lon = F.col("latitude"), F.col("longitude")
    x = places.dropna(subset=["latitude", "longitude"]).select("station_id", "latitude", "longitude", F.posexplode(days).alias("back", "day"))
    x = x.withColumn("rise", _event(F.col("day"), lat, lon, False)).withColumn("set_before", _event(F.date_sub("day", 1), lat, lon, True))
    usable = x.where((F.col("rise") <= micros(now)) | F.col("rise").isNull()).groupBy("station_id").agg(F.min_by(F.struct("rise", "set_before"), "back").alias("n")).where("n.rise is not null and n.set_before is not null")
    inside = micros("observed_at").between(F.col("n.set_before"), F.col("n.rise"))
    low = h.where("temperature_c is not null").join(usable, "station_id").where(inside)
    return low.groupBy("station_id").agg(F.min("temperature_c").alias("low_c"), F.timestamp_micros(F.first("n.set_before")).alias("from_at"), F.timestamp_micros(F.first("n.rise")).alias("to_at"))
