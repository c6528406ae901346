import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgelift.operators import parcel


def plain(t0, dew0, z0, heights):
    """One parcel, one step after the other."""

    def pressure(z):
        return 1013.25 * (1 - 2.25577e-5 * z) ** 5.25588

    def mixing(dew, z):
        e = 6.1094 * math.exp(17.625 * dew / (dew + 243.04))
        return 0.622 * e / (pressure(z) - e)

    def moist(t, z):
        k, w = t + 273.15, mixing(t, z)
        return 9.80665 * (1 + 2.501e6 * w / (287.04 * k)) / (9.80665 / 0.0098 + 2.501e6**2 * w * 0.622 / (287.04 * k * k))

    z, t, w = z0, t0, mixing(min(dew0, t0), z0)
    wet = w >= mixing(t, z)
    base, out = (z if wet else None), []
    for goal in heights:
        if goal <= z0:
            out.append(t0)
            continue
        while z < goal:
            step = min(10.0, goal - z)
            lapse = moist if wet else (lambda *_: 0.0098)
            nt = t - lapse(t - lapse(t, z) * step / 2, z + step / 2) * step
            if not wet and w >= mixing(nt, z + step):
                a, b = w - mixing(t, z), w - mixing(nt, z + step)
                share = a / (a - b) if a < 0 else 0.0
                t, z, wet = t + share * (nt - t), z + share * step, True
                base, w = z, mixing(t, z)
                continue
            t, z = nt, z + step
            w = mixing(t, z) if wet else w
        out.append(t)
    return out, base


def test_parcels_step_by_step(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        levels = [(float(z), float(rng.uniform(-20, 20)), float(rng.uniform(0, 15))) for z in sorted(rng.uniform(200, 5000, rng.integers(1, 8)))]
        rows.append((i, float(rng.uniform(-5, 30)), float(rng.choice([0.0, -1.0, rng.uniform(0, 20)])), float(rng.uniform(0, 1500)), levels))
    rows.append((40, 20.0, 20.0, 0.0, [(300.0, 15.0, 5.0)]))
    rows += [(100, None, 1.0, 0.0, rows[0][4]), (101, 10.0, 1.0, 0.0, [])]
    df = spark.createDataFrame(rows, "hour_id int, temperature_c double, dew_point_depression_c double, model_elevation_m double, levels array<struct<height_m:double,temperature_c:double,dew_point_depression_c:double>>")
    got = {r["hour_id"]: r for r in parcel.ascents(df).collect()}
    assert sorted(got) == list(range(41))
    for i, t0, depression, z0, levels in rows[:41]:
        want, base = plain(t0, t0 - depression, z0, [x[0] for x in levels])
        assert [x["parcel_c"] for x in got[i]["levels"]] == pytest.approx(want, abs=1e-9)
        assert got[i]["lcl_m"] == (None if base is None else pytest.approx(base, abs=1e-6))
        assert all(x["thermal_index_c"] == -x["buoyancy_c"] for x in got[i]["levels"])
    assert any(r["lcl_m"] is None for r in got.values()) and any(r["lcl_m"] for r in got.values())
    assert parcel.ascents(df.where(F.lit(False))).count() == 0
