"""Instants, local days and freshness. The session runs in UTC; zones are names of the tz database."""

from __future__ import annotations

import calendar
import functools
import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: First and last year whose wall clock times are known, and seconds of a day.
YEARS = (1900, 2199)
DAY_S = 86_400


def local_day(at: Column, zone: str | Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def local_hour(at: Column, zone: str | Column) -> Column:
    return F.hour(F.from_utc_timestamp(at, zone))


def local_instant(day: Column, hour: int, zone: str | Column) -> Column:
    """The instant of a wall clock hour; in a gap the next, in an overlap the first."""
    return F.to_utc_timestamp(F.to_timestamp(day) + F.expr(f"interval {hour} hours"), zone)


def cited(at: Column, zone: str | Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd'T'HH:mm")


def valid_time(reference: Column, hours: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(reference) + hours * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def offset_minutes(text: Column) -> Column:
    """Minutes of an offset like -08:00; null unless hours are at most 14 and minutes below 60."""
    sign, h, m = (F.regexp_extract(text, r"^([+-])(\d{2}):(\d{2})$", i) for i in (1, 2, 3))
    ok = text.rlike(r"^[+-]\d{2}:\d{2}$") & (h.try_cast("int") <= 14) & (m.try_cast("int") < 60)
    return F.when(ok, F.when(sign == "-", -1).otherwise(1) * (h.try_cast("int") * 60 + m.try_cast("int")))


def anchored_age(observed: Column, served: Column, received: Column, now: Column) -> Column:
    """Seconds: age when served plus time since receipt, each at least 0, so a wrong clock at the reader does no harm."""
    s = F.unix_timestamp
    return F.greatest(F.lit(0), s(served) - s(observed)) + F.greatest(F.lit(0), s(now) - s(received))


def reading_freshness(age_s: Column, current_s: int = 600, stale_s: int = 2700) -> Column:
    return F.when(age_s <= current_s, "live").when(age_s <= stale_s, "aging").otherwise("stale")


def poll_thresholds(poll_s: Column) -> tuple[Column, Column]:
    current = F.least(F.lit(600), F.greatest(F.lit(60), poll_s * 5))
    return current, F.least(F.lit(2700), F.greatest(F.lit(600), current * 6))


def run_freshness(age_h: Column, interval_h: float, lag_h: float, current: float, stale: float) -> Column:
    age = F.greatest(F.lit(0), age_h)
    return F.when(age <= current * interval_h + lag_h, "current").when(age <= stale * interval_h + lag_h, "delayed").otherwise("stale")


@functools.lru_cache
def _zone_table(zone: str) -> str:
    """JSON: for each year from `YEARS` on, the changes of a zone's offset that its days can meet (at_s, before, after), the offset that it begins with first."""
    java = SparkSession.active()._jvm.java.time
    rules = java.ZoneId.of(zone).getRules()
    year_s = [calendar.timegm((y, 1, 1, 0, 0, 0)) for y in range(YEARS[0], YEARS[1] + 2)]
    at = java.Instant.ofEpochSecond(year_s[0] - 2 * DAY_S)
    changes = []
    while (change := rules.nextTransition(at)) is not None and change.toEpochSecond() < year_s[-1] + 2 * DAY_S:
        changes.append((change.toEpochSecond(), change.getOffsetBefore().getTotalSeconds(), change.getOffsetAfter().getTotalSeconds()))
        at = change.getInstant()
    table = []
    for low, high in zip(year_s[:-1], year_s[1:], strict=True):
        start = low - 2 * DAY_S
        offset = rules.getOffset(java.Instant.ofEpochSecond(start)).getTotalSeconds()
        table.append([(start, offset, offset), *(c for c in changes if start < c[0] < high + 2 * DAY_S)])
    return json.dumps([[{"at_s": a, "before": b, "after": c} for a, b, c in year] for year in table])


def naive_instant(text: Column, zone: str, after_s: Column | None = None, near_s: Column | None = None) -> Column:
    """Seconds since 1970 of a wall clock time without a zone (yyyy-MM-dd'T'HH:mm:ss); null if it is none, or of a year outside `YEARS`.

    The last change of the zone's offset that the wall clock has reached decides: behind a gap or an overlap the offset after it holds. A time in a gap is the instant of the change. Of the two
    instants in an overlap it is the first later than after_s (else the second), or the one nearest near_s, or the first.
    """
    at = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), text), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    wall = F.unix_timestamp(at)
    year = F.year(at) - YEARS[0]
    table = F.from_json(F.lit(_zone_table(zone)), "array<array<struct<at_s:bigint,before:int,after:int>>>")
    met = F.filter(F.get(table, F.when(year >= 0, year)), lambda c: c["at_s"] + F.least(c["before"], c["after"]) <= wall)
    change = F.try_element_at(met, F.lit(-1))
    first, second = wall - change["before"], wall - change["after"]
    twice = (change["after"] < change["before"]) & (wall < change["at_s"] + change["before"])
    gap = (change["after"] > change["before"]) & (wall < change["at_s"] + change["after"])
    if after_s is not None:
        use_first = after_s.isNull() | (first > after_s)
    elif near_s is not None:
        use_first = near_s.isNull() | (F.abs(first - near_s) <= F.abs(second - near_s))
    else:
        use_first = F.lit(True)
    return F.when(gap, change["at_s"]).when(twice & use_first, first).otherwise(second)
