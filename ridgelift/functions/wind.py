"""Angles and wind. Directions say where the wind comes from, in degrees clockwise from north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RAD = math.pi / 180
#: Below this speed the air is calm and has no direction.
CALM_MPS = 0.5
PLAUSIBLE_MPS = 140.0
KMH_PER_MPS, KNOTS_PER_MPS, MPH_PER_MPS = 3.6, 3600 / 1852, 3600 / 1609.344
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def normalize(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0)) + 0.0


def signed(deg: Column, half: float = 180.0) -> Column:
    """Into [-half, half)."""
    return F.pmod(deg + half, F.lit(2 * half)) - half


def radians(deg: Column) -> Column:
    """Multiplied first, divided then, as the SQL twins do: a mean wind at its floor, or at a tie of its rounding, depends on the last bit."""
    return deg * math.pi / 180.0


def u_of(speed: Column, deg: Column) -> Column:
    return -speed * F.sin(radians(deg))


def v_of(speed: Column, deg: Column) -> Column:
    return -speed * F.cos(radians(deg))


def speed_of(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction_of(u: Column, v: Column) -> Column:
    """0 for still air."""
    return F.when((u == 0) & (v == 0), F.lit(0.0)).otherwise(normalize(F.atan2(-u, -v) / RAD))


def is_calm(speed: Column) -> Column:
    return speed < CALM_MPS


def blowing(speed: Column, deg: Column) -> Column:
    return (speed >= CALM_MPS) & deg.isNotNull()


def circular_mean(deg: Column, where: Column | None = None) -> Column:
    """Aggregate: mean bearing by unit vectors; null of nothing."""
    d = deg if where is None else F.when(where, deg)
    return F.when(F.count(d) > 0, normalize(F.atan2(F.sum(F.sin(d * RAD)), F.sum(F.cos(d * RAD))) / RAD))


def vector_mean(speed: Column, deg: Column) -> tuple[Column, Column]:
    """Aggregates: (speed, direction or null if calm). Rows without a direction weigh the mean down."""
    u, v = (F.coalesce(F.sum(f(speed, deg)), F.lit(0.0)) / F.count("*") for f in (u_of, v_of))
    s = F.when(F.count("*") > 0, speed_of(u, v)).otherwise(0.0)
    return s, F.when(s >= CALM_MPS, direction_of(u, v))


def sector(deg: Column, sectors: int) -> Column:
    """The nearest of evenly spread sectors; ties go clockwise."""
    return (F.floor(normalize(deg) / (360.0 / sectors) + 0.5).cast("int") % sectors).cast("int")


def compass(deg: Column) -> Column:
    # element_at of a literal array does not give null for a null place
    return F.when(deg.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in COMPASS]), sector(deg, 16) + 1))


def in_arc(deg: Column, start: float | Column, end: float | Column) -> Column:
    """Both ends inside; an arc may pass north."""
    a, b = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (start, end))
    return F.when(a <= b, (deg >= a) & (deg <= b)).otherwise((deg >= a) | (deg <= b))


def arc_span(start: Column, end: Column) -> Column:
    return F.pmod(end - start, F.lit(360.0))


def band(speed: Column, bounds: tuple[float, ...]) -> Column:
    """How many bounds the speed reaches."""
    total = F.lit(0)
    for b in bounds:
        total = total + (speed >= b).cast("int")
    return total


def barbs(speed_kmh: Column) -> tuple[Column, Column, Column, Column]:
    """Speed rounded to 5 km/h, and its pennants (50), full (10) and half barbs (5)."""
    fives = F.greatest(F.lit(0), F.floor(speed_kmh / 5 + 0.5).cast("int"))
    return fives * 5, F.floor(fives / 10).cast("int"), F.floor(fives % 10 / 2).cast("int"), (fives % 2).cast("int")


def shear(u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    return speed_of(u2 - u1, v2 - v1)
