"""Moisture, stability and thermals. Temperatures in Celsius, heights in metres, pressures in hPa."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp

# Magnus coefficients, ratio of the gas constants, dry adiabatic lapse.
MAGNUS_A, MAGNUS_B, MAGNUS_E0 = 17.625, 243.04, 6.1094
EPSILON = 0.622
DRY_LAPSE = 0.0098
SATURATED = 0.5
#: Fixed values: (largest temperature change in C per 1000 ft, class), in order.
STABILITY = (
    (-3.0, "very-unstable"),
    (-2.5, "unstable"),
    (-2.0, "conditional-strong"),
    (-1.5, "conditional"),
    (-1.2, "near-neutral"),
    (0.0, "stable"),
    (0.5, "inverted"),
)
FEET_1000 = 304.8
# Smoke extinction (m2/g) and transmittance coefficients for midday and for a vertical path.
EXTINCTION, SMOKE_MIDDAY, SMOKE_VERTICAL, LOWEST_COSINE = 4.7, 0.16, 0.13, 0.15


def _gamma(t: Column) -> Column:
    return t * MAGNUS_A / (t + MAGNUS_B)


def saturation_pressure(t: Column) -> Column:
    return F.exp(_gamma(t)) * MAGNUS_E0


def relative_humidity(t: Column, dew: Column) -> Column:
    return clamp(F.exp(_gamma(dew) - _gamma(t)) * 100, float("-inf"), 100.0)


def dew_point(t: Column, rh: Column) -> Column:
    g = F.ln(clamp(rh, 1.0, 100.0) / 100) + _gamma(t)
    return g * MAGNUS_B / (F.lit(MAGNUS_A) - g)


def mixing_ratio(dew: Column, p: Column) -> Column:
    e = saturation_pressure(dew)
    return e * EPSILON / (p - e)


def virtual_temperature(t: Column, w: Column) -> Column:
    return (t + 273.15) * (w / EPSILON + 1) / (w + 1) - 273.15


def lcl_agl(t: Column, dew: Column) -> Column:
    """Height at which a surface parcel saturates (Bolton 1980, eq. 15); 0 if it already is."""
    tk, dk = t + 273.15, dew + 273.15
    at = 1.0 / (1.0 / (dk - 56.0) + F.ln(tk / dk) / 800.0) + 56.0
    return F.when(dew >= t, 0.0).otherwise(F.greatest(F.lit(0.0), (tk - at) / DRY_LAPSE))


def thermal_velocity(t: Column, sensible: Column, latent: Column, depth: Column, first_pressure: Column) -> Column:
    """Convective velocity scale; 0 without a boundary layer, a level or an upward heat flux."""
    tk = t + 273.15
    flux = sensible + tk * 0.000245268 * latent
    theta = tk * F.pow(F.lit(1015.0) / first_pressure, F.lit(0.28482))
    return F.when((depth <= 0) | first_pressure.isNull() | (flux <= 0), 0.0).otherwise(F.cbrt(F.lit(0.0075516) / theta * flux * depth))


def lapse_per_km(t_low: Column, z_low: Column, t_high: Column, z_high: Column) -> Column:
    """Change of temperature with height in C per km, negative when it cools; null without thickness."""
    return F.when(z_high != z_low, (t_high - t_low) / (z_high - z_low) * 1000)


def stability(change_per_1000_ft: Column) -> Column:
    out = F.lit("strong-inversion")
    for most, name in reversed(STABILITY):
        out = F.when(change_per_1000_ft <= most, name).otherwise(out)
    return F.when(change_per_1000_ft.isNotNull(), out)


def sea_level_pressure(p: Column, elevation: Column, t: Column) -> Column:
    k = F.coalesce(t, F.lit(15.0))
    return p * F.pow(1 - elevation * 0.0065 / (k + elevation * 0.0065 + 273.15), F.lit(-5.257))


def omega(w: Column, p: Column, t: Column) -> Column:
    """Pressure velocity (Pa/s) of a geometric one (m/s)."""
    return -(p * 100 / ((t + 273.15) * 287.05)) * 9.80665 * w


def smoke_aot(column_mg_m2: Column) -> Column:
    """Optical thickness of a smoke column; 0 of none."""
    return F.when(column_mg_m2 > 0, column_mg_m2 / 1000 * EXTINCTION).otherwise(0.0)


def smoke_transmittance(aot: Column, cos_zenith: Column | None = None) -> Column:
    """Share of sunlight left by smoke: at midday, or along the slant path, whose lengthening ends at a low sun; 1 by night."""
    if cos_zenith is None:
        return F.when(aot > 0, F.exp(aot * -SMOKE_MIDDAY)).otherwise(1.0)
    return F.when((aot > 0) & (cos_zenith > 0), F.exp(aot * -SMOKE_VERTICAL / F.greatest(cos_zenith, F.lit(LOWEST_COSINE)))).otherwise(1.0)


def smoke_adjusted_velocity(w: Column, transmittance: Column) -> Column:
    return F.when(w > 0, w * F.cbrt(clamp(transmittance, 0.0, 1.0))).otherwise(0.0)


def buoyancy_shear(w: Column, shear: Column) -> tuple[Column, Column]:
    """(ratio, unopposed): without shear there is no ratio, and thermals, if any, are unopposed."""
    return F.when(shear != 0, w / shear), (shear == 0) & (w != 0)
