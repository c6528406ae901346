"""Ties and last bits of findings; what the check's larger tables brought up."""

import datetime as dt
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from ridgelift.llm import nearest
from ridgelift.operators import compare, series, trajectories
from ridgelift.plans import catalogue

ZONE = "America/Vancouver"


def test_a_mean_wind_at_its_floor(spark):
    """One level of 1 m/s: whether it has a direction depends on the last bit, and the SQL multiplies before it divides."""
    with duckdb.connect() as c:
        want = dict(c.execute("select d, case when sqrt(u * u + v * v) >= 1 then d end from (select d, -1.0::double * sin(d::double * pi() / 180) as u, -1.0::double * cos(d::double * pi() / 180) as v from range(360) r(d))").fetchall())
    hours = spark.range(360).select(F.col("id").alias("profile_id"), F.lit(0).alias("window_id"), F.lit(0.0).alias("launch_m"), F.lit(900.0).alias("usable_lift_top_m"), F.array(F.struct(F.lit(500.0).alias("height_m"), F.lit(1.0).alias("wind_speed_mps"), F.col("id").cast("double").alias("wind_direction_deg"))).alias("levels"))
    got = {r["profile_id"]: r["direction_deg"] for r in series.window_band_direction(hours).collect()}
    assert {d for d in got if got[d] != want[d]} <= {183, 297}  # whose sines differ between the two engines' libraries


def windows_of_a_day(spark):
    at = lambda h: dt.datetime(2026, 7, 1, h)
    rows = [(1, 0, "2026-07-01", i, at(19 if i < 20 else 20), at(19 if i < 20 else 20), i == 0, i == 39, float(i + 1), "2026-07-01", "2026-07-01") for i in range(40)]
    random.Random(3).shuffle(rows)
    kind = "site long, member long, day string, window_id long, start_at timestamp, end_at timestamp, clipped_start boolean, clipped_end boolean, step_h double, start_day string, end_day string"
    return spark.createDataFrame(rows, kind).repartition(5)


def test_equal_edges_of_a_day(spark):
    """Twenty windows start at once and twenty end at once. The first of all and the last of all are clipped, so the day has neither edge."""
    w = windows_of_a_day(spark)
    runs = spark.createDataFrame([(1, 0, dt.datetime(2026, 6, 30))], "site long, member long, reference_time timestamp")
    assert trajectories.edges(w, runs, ZONE).count() == 0
    inner = w.where("window_id > 0 and window_id < 39")
    assert {r["edge"]: r["step_h"] for r in trajectories.edges(inner, runs, ZONE).collect()} == {"start": 2.0, "end": 39.0}
    two = w.unionByName(inner.withColumn("member", F.lit(1).cast("long"))).unionByName(inner.withColumn("member", F.lit(2).cast("long")).withColumn("start_at", F.col("start_at") + F.expr("interval 1 hour")))
    (r,) = compare.timing(two).collect()
    assert (r["start_spread_h"], r["end_spread_h"]) == (1.0, 0.0)


def test_words_tell_the_season(spark):
    """The share of the year since 21 December is part of the words again, in the query and in its SQL."""
    with duckdb.connect() as c:
        c.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
        want = {r[0]: r[1] for r in c.execute(f"select seq, season from ({catalogue.oracle_sql()['d09_d10_words']}) x").fetchall()}
    got = {r["seq"]: r["season"] for r in catalogue.queries()["d09_d10_words"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and min(got.values()) > 0


def test_equal_spans_are_lit_once(spark):
    row = (1, 1, "2026-07-01", "2026-07-01", dt.datetime(2026, 7, 1, 19), dt.datetime(2026, 7, 1, 19), 1.0)
    kind = "site long, member long, day string, own_day string, start_at timestamp, end_at timestamp, step_h double"
    (r,) = compare.lit_spans(spark.createDataFrame([row] * 30, kind).repartition(7), ZONE).collect()
    assert (r["from_at"], r["to_at"]) == (dt.datetime(2026, 7, 1, 19), dt.datetime(2026, 7, 1, 20))


def test_nearest_of_any_rows(spark, tmp_path):
    """Clusters tighter than codewords tell apart, queries unlike the rest, and a few rows among many copies: the five nearest are those of all pairs."""
    rng = np.random.default_rng(5)
    n, dim = 3000, 16
    ids = np.arange(n)
    tight = rng.normal(size=(4, dim))[rng.integers(0, 4, n)] + rng.normal(size=(n, dim)) * 1e-3
    apart = tight.copy()
    apart[ids % 50 == 0] = rng.normal(size=((ids % 50 == 0).sum(), dim))
    copies = rng.normal(size=(n, dim))
    copies[rng.random(n) < 0.9] = copies[7]
    for name, x in (("tight", tight), ("apart", apart), ("copies", copies)):
        d = tmp_path / name
        d.mkdir()
        spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").write.parquet(str(d / "embeddings.parquet"))
        got = {}
        for r in nearest.op4_nearest(spark, str(d)).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        caught = 0
        for i in ids[ids % 50 == 0]:
            s = np.round(unit @ unit[i], 13)
            s[i] = -2
            caught += len(set(got[i].values()) & set(np.lexsort((ids, -s))[:5].tolist()))
        assert caught == 5 * (ids % 50 == 0).sum(), name


def test_quiet_days_read_the_hours_once(spark):
    plan = catalogue.queries()["f03_quiet_day_context"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # orders and lineitem


def test_windows_read_the_hours_once(spark):
    """Levels are sent to their hour, and not from there to their profile."""
    for name in ("c04_timing_envelope", "f01_thermal_window", "f09_wind_exceedance"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2, name  # orders and lineitem
        by_profile = plan.split("Exchange hashpartitioning(profile_id")[-1].split("+- Project [")[1].split("]")[0]
        assert "levels#" not in by_profile, name
