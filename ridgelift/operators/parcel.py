"""A surface parcel lifted through an hour's levels: dry below saturation, along the pseudo-adiabat above. Buoyancy compares virtual temperatures.

The ascent is an integration in steps of ten metres that ends exactly on each level, with a branch where the parcel saturates; column expressions would evaluate it step by step
and uncompiled. So it runs over Arrow batches instead, all hours of a batch one step together. Hours are independent: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelift.functions.air import DRY_LAPSE, EPSILON, MAGNUS_A, MAGNUS_B, MAGNUS_E0

STEP_M = 10.0
# Standard gravity, gas constant of dry air, latent heat, and the heat capacity that goes with the dry lapse.
GRAVITY, R_DRY, LATENT = 9.80665, 287.04, 2.501e6
HEAT = GRAVITY / DRY_LAPSE


def pressure(z: np.ndarray) -> np.ndarray:
    """The standard atmosphere's, in hPa."""
    return 1013.25 * (1 - 2.25577e-5 * z) ** 5.25588


def mixing(dew: np.ndarray, z: np.ndarray) -> np.ndarray:
    e = np.exp(MAGNUS_A * dew / (dew + MAGNUS_B)) * MAGNUS_E0
    return EPSILON * e / (pressure(z) - e)


def moist_lapse(t: np.ndarray, z: np.ndarray) -> np.ndarray:
    k, w = t + 273.15, mixing(t, z)
    return GRAVITY * (1 + LATENT * w / (R_DRY * k)) / (HEAT + LATENT * LATENT * w * EPSILON / (R_DRY * k**2))


def virtual(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (t + 273.15) * (w / EPSILON + 1) / (w + 1) - 273.15


def lift(t0: np.ndarray, dew0: np.ndarray, z0: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parcels from (t0, dew0, z0) to each of their ascending heights (NaN behind the last): temperatures and vapour there, and the height of saturation (NaN if none)."""
    n, levels = heights.shape
    z, t, w = z0.copy(), t0.copy(), mixing(np.minimum(dew0, t0), z0)
    start_w = w.copy()
    wet = w >= mixing(t, z)
    base = np.where(wet, z, np.nan)
    out_t, out_w = np.full((n, levels), np.nan), np.full((n, levels), np.nan)
    for k in range(levels):
        goal = heights[:, k]
        low = goal <= z0
        while len(on := np.flatnonzero(z < np.where(np.isnan(goal), -np.inf, goal))):
            step = np.minimum(STEP_M, goal[on] - z[on])
            slope = lambda x, y, s=on: np.where(wet[s], -moist_lapse(x, y), -DRY_LAPSE)
            half = t[on] + slope(t[on], z[on]) * step / 2
            new_t, new_z = t[on] + slope(half, z[on] + step / 2) * step, z[on] + step
            before, after = w[on] - mixing(t[on], z[on]), w[on] - mixing(new_t, new_z)
            crosses = ~wet[on] & (after >= 0)
            share = np.where(crosses & (before < 0), before / np.where(before == after, 1, before - after), 0.0)
            moved = np.where(crosses, share, 1.0)
            t[on], z[on] = np.where(crosses, t[on] + moved * (new_t - t[on]), new_t), np.where(crosses, z[on] + moved * step, new_z)
            base[on] = np.where(crosses, z[on], base[on])
            wet[on] |= crosses
            w[on] = np.where(wet[on], mixing(t[on], z[on]), w[on])
        out_t[:, k] = np.where(low, t0, np.where(np.isnan(goal), np.nan, t))
        out_w[:, k] = np.where(low, start_w, np.where(np.isnan(goal), np.nan, w))
    return out_t, out_w, base


def ascents(h: DataFrame) -> DataFrame:
    """h (hour_id, temperature_c, dew_point_depression_c, model_elevation_m, levels) as hour_id, lcl_m (null if the column never saturates) and levels: height_m, parcel_c, buoyancy_c and
    thermal_index_c of each. Levels at or below the ground hold the unlifted parcel; dew points above the temperature count as it. Hours without a temperature, depression or level are left out."""
    whole = h.where(F.col("temperature_c").isNotNull() & F.col("dew_point_depression_c").isNotNull() & (F.size("levels") > 0))
    column = lambda c: F.transform("levels", lambda v: v[c]).alias(c)
    rows = whole.select("hour_id", F.col("temperature_c").alias("t0"), (F.col("temperature_c") - F.col("dew_point_depression_c")).alias("dew0"), F.col("model_elevation_m").alias("z0"), column("height_m"), column("temperature_c"), column("dew_point_depression_c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["height_m"].map(len).to_numpy()
            wide = np.full((3, len(b), n.max() if len(b) else 0), np.nan)
            for i, c in enumerate(("height_m", "temperature_c", "dew_point_depression_c")):
                for r, v in enumerate(b[c]):
                    wide[i, r, : len(v)] = v
            z, env_t, env_d = wide
            t, w, base = lift(*(b[c].to_numpy(float) for c in ("t0", "dew0", "z0")), z)
            buoyancy = virtual(t, w) - virtual(env_t, mixing(np.minimum(env_t - env_d, env_t), z))
            levels = [[(float(z[r, k]), float(t[r, k]), float(buoyancy[r, k]), float(-buoyancy[r, k])) for k in range(n[r])] for r in range(len(b))]
            names = ("height_m", "parcel_c", "buoyancy_c", "thermal_index_c")
            yield pd.DataFrame({"hour_id": b["hour_id"], "lcl_m": [None if np.isnan(x) else float(x) for x in base], "levels": [[dict(zip(names, x, strict=True)) for x in row] for row in levels]})

    kind = h.schema["hour_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"hour_id {kind}, lcl_m double, levels array<struct<height_m:double,parcel_c:double,buoyancy_c:double,thermal_index_c:double>>")
