"""The sun: zenith, clear-sky irradiance, sunrise and sunset, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAD = 0.017453292519943295


def cos_zenith(at: Column, lat: Column, lon: Column) -> Column:
    """Cosine of the solar zenith angle at a UTC instant, negative at night (Fourier series of Spencer 1971)."""
    hours = F.hour(at) + F.minute(at) / 60.0 + F.second(at) / 3600.0
    g = (F.dayofyear(at) - 1 + hours / 24) * (2 * 3.141592653589793 / 365)
    dec = F.lit(0.006918) - F.cos(g) * 0.399912 + F.sin(g) * 0.070257 - F.cos(g * 2) * 0.006758 + F.sin(g * 2) * 0.000907 - F.cos(g * 3) * 0.002697 + F.sin(g * 3) * 0.00148
    eot = (F.lit(0.000075) + F.cos(g) * 0.001868 - F.sin(g) * 0.032077 - F.cos(g * 2) * 0.014615 - F.sin(g * 2) * 0.040849) * 229.18
    angle = (hours + lon / 15 + eot / 60 - 12) * 15 * RAD
    return F.sin(lat * RAD) * F.sin(dec) + F.cos(lat * RAD) * F.cos(dec) * F.cos(angle)


def clear_sky_ghi(cosz: Column) -> Column:
    """Haurwitz: 1098 cos(z) exp(-0.059 / cos(z)); 0 at night."""
    return F.when(cosz > 0, cosz * 1098 * F.exp(F.lit(-0.059) / cosz)).otherwise(0.0)


def observed_transmittance(ghi: Column, cosz: Column) -> Column:
    """Measured over clear-sky irradiance, at most 1.5; null near the horizon."""
    return F.when((cosz >= 0.15) & (ghi >= 0), F.least(F.lit(1.5), ghi / clear_sky_ghi(cosz)))


def _let(x: Column, body) -> Column:
    """body(x) with x computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _event(day: Column, lat: Column, lon: Column, sign: float, at: Column) -> Column:
    """Hours after 00 UTC of `day` of the sunrise (sign -1) or sunset (+1), with the sun's place `at` days into it."""

    def of_century(c: Column) -> Column:
        mean_long = F.pmod(c * (c * 0.0003032 + 36000.76983) + 280.46646, F.lit(360.0))
        anomaly = (c * (35999.05029 - c * 0.0001537) + 357.52911) * RAD
        ecc = F.lit(0.016708634) - c * (c * 0.0000001267 + 0.000042037)
        centre = F.sin(anomaly) * (1.914602 - c * (c * 0.000014 + 0.004817)) + F.sin(anomaly * 2) * (0.019993 - c * 0.000101) + F.sin(anomaly * 3) * 0.000289
        node = (125.04 - c * 1934.136) * RAD
        tilt = (((21.448 - c * (c * (0.00059 - c * 0.001813) + 46.815)) / 60 + 26) / 60 + 23 + F.cos(node) * 0.00256) * RAD
        return F.struct((mean_long * RAD).alias("m"), anomaly.alias("a"), ecc.alias("e"), ((mean_long + centre - 0.00569 - F.sin(node) * 0.00478) * RAD).alias("apparent"), tilt.alias("tilt"))

    def hours(s: Column) -> Column:
        dec = F.asin(F.sin(s["tilt"]) * F.sin(s["apparent"]))
        y = F.pow(F.tan(s["tilt"] / 2), F.lit(2.0))
        eot = (y * F.sin(s["m"] * 2) - s["e"] * 2 * F.sin(s["a"]) + s["e"] * y * 4 * F.sin(s["a"]) * F.cos(s["m"] * 2) - y * y * 0.5 * F.sin(s["m"] * 4) - s["e"] * s["e"] * 1.25 * F.sin(s["a"] * 2)) / RAD * 4
        cos_h = F.cos(F.lit(90.833 * RAD)) / (F.cos(lat * RAD) * F.cos(dec)) - F.tan(lat * RAD) * F.tan(dec)
        angle = F.when(F.abs(cos_h) <= 1, F.acos(cos_h) / RAD)
        return (720 - (lon - angle * sign) * 4 - eot) / 60

    century = (F.datediff(day, F.lit("2000-01-01").cast("date")) - 0.5 + at) / 36525.0
    return _let(_let(century, of_century), hours)


def sun_event(day: Column, lat: Column, lon: Column, sunset: bool) -> Column:
    """Hours after 00 UTC of the day; null under a polar sky. The second pass uses the sun's place at the first's time."""
    sign = 1.0 if sunset else -1.0
    return _let(_event(day, lat, lon, sign, F.lit(0.0)) / 24, lambda at: _event(day, lat, lon, sign, at))
