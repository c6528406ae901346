"""What documents say about themselves: tags of their contents, kinds of values, schedules of levels and the meaning of gusts and rain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start and factor of the hash's two lanes, the levels of late hours, and the kinds of gusts and rain that documents declare.
LANES, FACTOR, WORD = (0x811C9DC5, 0x01234567), 0x01000193, 0xFFFFFFFF
LATE_LEVELS_HPA = (1000, 925, 850, 700)
LAST_DENSE_HOUR, SPARSE_HOURS = 168, 6
CONDITIONS = "dew_point_c double, last_lightning_strike_at timestamp, last_lightning_strike_distance_km double, lightning_strikes_last_hour int, precipitation_minutes_today double, precipitation_rate_mm_per_hour double, precipitation_today_mm double, pressure_trend string, relative_humidity_pct double, sea_level_pressure_hpa double, solar_radiation_wm2 double, uv_index double"


def weak_tag(json: Column) -> Column:
    """A weak entity tag of a text: two lanes of FNV-1a over its UTF-16 units, sixteen digits."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(json, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    lanes = [F.aggregate(units, F.lit(start).cast("long"), lambda h, u: (h.bitwiseXOR(u) * FACTOR).bitwiseAND(F.lit(WORD))) for start in LANES]
    return F.concat(F.lit('W/"'), *[F.lower(F.lpad(F.hex(x), 8, "0")) for x in lanes], F.lit('"'))


def tag_matches(asked: Column, tag: Column) -> Column:
    """Whether a list of tags that a reader holds names this one, weak or strong; `*` names any."""
    bare = lambda t: F.regexp_replace(F.trim(t), "^W/", "")
    return F.coalesce((F.trim(asked) == "*") | F.exists(F.split(asked, ","), lambda t: bare(t) == bare(tag)), F.lit(False))


def is_dropout(block: Column) -> Column:
    """An ensemble's block without any member: there, and empty."""
    return F.coalesce(block["members"] == 0, F.lit(False))


def is_deterministic(run_members: Column) -> Column:
    """A run that declares no members is deterministic, whatever its values look like."""
    return run_members.isNull()


def dense_hour(forecast_hour: Column) -> Column:
    """Whether an hour carries all levels and CAPE: all up to a lead, then every so many hours."""
    return (forecast_hour <= LAST_DENSE_HOUR) | (forecast_hour % SPARSE_HOURS == 0)


def scheduled_levels(forecast_hour: Column, all_hpa: tuple[int, ...]) -> Column:
    return F.when(dense_hour(forecast_hour), F.array(*[F.lit(p) for p in all_hpa])).otherwise(F.array(*[F.lit(p) for p in LATE_LEVELS_HPA]))


def semantics(rain_window: Column, rain_total: Column, gust_max: Column) -> Column:
    """What gusts and rain mean, from the variables that a model publishes (names, null where it does not): accumulations become means of a window, a rate is of an instant; gusts are undeclared without a maximum."""
    rain = F.when(rain_window.isNotNull() | rain_total.isNotNull(), "windowMeanRate").otherwise("instantRate")
    return F.struct(rain.alias("precipitation"), F.when(gust_max.isNotNull(), "hourMax").alias("gust"))


def no_conditions(**known: Column) -> Column:
    """Air conditions with nothing measured but what is given."""
    fields = [f.split(" ") for f in CONDITIONS.split(", ")]
    unknown = set(known) - {n for n, _ in fields}
    if unknown:
        raise ValueError(f"no such conditions: {sorted(unknown)}")
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def unavailable(meta: Column, reason: Column, reading: str) -> Column:
    """A station that cannot be read: what is known of it, why, and no reading."""
    return F.struct(meta.alias("meta"), F.lit("unavailable").alias("status"), reason.alias("reason"), F.lit(None).cast(reading).alias("reading"))
