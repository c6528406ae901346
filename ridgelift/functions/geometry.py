"""Places on grids: rotated and conic grids, a geostationary view, cells of a raster. All angles are degrees unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wind import RAD, signed

#: Metres in a degree of latitude, and of longitude at the equator.
M_PER_DEG_LAT, M_PER_DEG_LON = 111_132.0, 111_320.0


def wind_from_uv(u: Column, v: Column) -> tuple[Column, Column]:
    """(speed, direction) of components; still air has the direction that its signs of zero give, not a null."""
    return F.hypot(u, v), F.pmod(F.atan2(-u, -v) * (180 / math.pi), F.lit(360.0))


def _unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(lat * RAD) * F.cos(lon * RAD), F.cos(lat * RAD) * F.sin(lon * RAD), F.sin(lat * RAD)


def _tangents(lat: Column, lon: Column) -> tuple[tuple, tuple]:
    """East and north at a place given in radians."""
    east = (-F.sin(lon), F.cos(lon), F.lit(0.0))
    return east, (-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat))


def _turn(v: tuple, pole_lat: float, pole_lon: float, back: bool) -> tuple[Column, Column, Column]:
    """A vector of the geographic frame in the frame whose south pole is given, or back."""
    z, y = pole_lon * RAD, (90 + pole_lat) * RAD
    a, b, c = v
    if back:
        x = a * math.cos(y) - c * math.sin(y)
        return x * math.cos(z) - b * math.sin(z), x * math.sin(z) + b * math.cos(z), a * math.sin(y) + c * math.cos(y)
    x = a * math.cos(z) + b * math.sin(z)
    return x * math.cos(y) + c * math.sin(y), b * math.cos(z) - a * math.sin(z), c * math.cos(y) - x * math.sin(y)


def _place(v: tuple) -> tuple[Column, Column]:
    """Latitude and longitude in radians."""
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[2]))), F.atan2(v[1], v[0])


def to_rotated(lat: Column, lon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    return tuple(c / RAD for c in _place(_turn(_unit(lat, lon), pole_lat, pole_lon, False)))


def from_rotated(lat: Column, lon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    return tuple(c / RAD for c in _place(_turn(_unit(lat, lon), pole_lat, pole_lon, True)))


def rotated_wind(u: Column, v: Column, lat: Column, lon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """True east and north components of a wind that is given along a rotated grid's axes."""
    here = _place(_turn(_unit(lat, lon), pole_lat, pole_lon, False))
    east, north = _tangents(*here)
    true = _turn(tuple(u * e + v * n for e, n in zip(east, north, strict=True)), pole_lat, pole_lon, True)
    east, north = _tangents(lat * RAD, lon * RAD)
    return tuple(true[0] * a[0] + true[1] * a[1] + true[2] * a[2] for a in (east, north))


def cone(lat1: float, lat2: float) -> float:
    """The constant of a conformal cone that touches or cuts the globe at two latitudes."""
    a, b = lat1 * RAD, lat2 * RAD
    if lat1 == lat2:
        return math.sin(a)
    return math.log(math.cos(a) / math.cos(b)) / math.log(math.tan(math.pi / 4 + b / 2) / math.tan(math.pi / 4 + a / 2))


def cone_rotation(lon: Column, orientation: float, constant: float) -> Column:
    """Degrees from grid north to true north."""
    return signed(lon - orientation) * constant


def cone_wind(u: Column, v: Column, lon: Column, orientation: float, constant: float) -> tuple[Column, Column]:
    a = cone_rotation(lon, orientation, constant) * RAD
    return u * F.cos(a) + v * F.sin(a), v * F.cos(a) - u * F.sin(a)


def scan_angles(lat: Column, lon: Column, lon0: float, height_m: float, equator_m: float, pole_m: float) -> tuple[Column, Column]:
    """East-west and north-south scan angles (radians) of a place seen by a geostationary imager on a fixed grid; null beyond the horizon."""
    far, flat = height_m + equator_m, (pole_m / equator_m) ** 2
    g = F.atan(F.tan(lat * RAD) * flat)
    r = F.lit(pole_m) / F.sqrt(1 - F.cos(g) * F.cos(g) * (1 - flat))
    turn = lon * RAD - lon0 * RAD
    x, y, z = far - r * F.cos(g) * F.cos(turn), -r * F.cos(g) * F.sin(turn), r * F.sin(g)
    seen = (far - x) * far >= y * y + z * z / flat
    return F.when(seen, F.asin(-y / F.sqrt(x * x + y * y + z * z))), F.when(seen, F.atan(z / x))


def nearest_index(axis: Column, value: Column, most: float) -> Column:
    """Place (from 0) of the axis value nearest to value, the first of ties; null if none is within `most`."""
    gaps = F.transform(axis, lambda a, i: F.struct(F.abs(a - value).alias("far"), i.alias("i")))
    best = F.array_min(gaps)
    return F.when(best["far"] <= most, best["i"])


def horn(z: list[Column], x_m: Column | float, y_m: Column | float) -> tuple[Column, Column]:
    """Slope and downslope aspect at the middle of nine heights, rows from north to south (Horn 1981)."""
    a, b, c, d, _, f, g, h, i = z
    east = ((c + f * 2 + i) - (a + d * 2 + g)) / (8 * x_m)
    north = ((a + b * 2 + c) - (g + h * 2 + i)) / (8 * y_m)
    return F.atan(F.hypot(east, north)) / RAD, F.pmod(F.atan2(-east, -north) / RAD + 360.0, F.lit(360.0))


def bilinear(q00: Column, q01: Column, q10: Column, q11: Column, tx: Column, ty: Column) -> Column:
    """Between four cells (row 0 and 1, column 0 and 1); null if one of them is."""
    return q00 * (1 - tx) * (1 - ty) + q01 * tx * (1 - ty) + q10 * (1 - tx) * ty + q11 * tx * ty


def m_per_deg_lon(lat: Column) -> Column:
    return F.cos(lat * RAD) * M_PER_DEG_LON


def in_disc(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, radius_m: float) -> Column:
    """In a disc of planar metres around a centre."""
    dx, dy = (lon - centre_lon) * m_per_deg_lon(centre_lat), (lat - centre_lat) * M_PER_DEG_LAT
    return dx * dx + dy * dy <= radius_m * radius_m


def tile(degrees: Column, positive: str, negative: str, width: int) -> Column:
    """A tile's name for one axis: a letter for the hemisphere, and whole degrees with leading zeros."""
    whole = F.floor(degrees)
    return F.concat(F.when(whole >= 0, positive).otherwise(negative), F.lpad(F.abs(whole).cast("string"), width, "0"))
