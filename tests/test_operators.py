import datetime as dt
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgelift.functions import air, numbers, sun, times, wind
from ridgelift.operators import compare, derive, findings, publish, sequences, station
from ridgelift.sources import gridded, vendors
from ridgelift.streaming import live

T0 = dt.datetime(2026, 7, 1, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_rounding(spark):
    x = spark.createDataFrame([(0.285,), (2.675,), (-2.5,), (0.125,), (None,)], "x double")
    assert [r[0] for r in x.select(numbers.nudge_round(F.col("x"), 2)).collect()] == [0.29 if math.floor(0.285 * 100 + 0.5) == 29 else 0.28, 2.68 if math.floor(2.675 * 100 + 0.5) == 268 else 2.67, -2.5, 0.13, None]
    assert [r[0] for r in x.select(numbers.exact_half_even(2)(F.col("x"))).collect()] == [0.28, 2.67, -2.5, 0.12, None]
    assert one(spark, numbers.nudge_round(F.lit(-2.5))) == -2.0


def test_exact_rounding_of_many(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    rng = np.random.default_rng(2)
    values = [float(v) for v in np.concatenate([rng.normal(0, 100, 500), rng.integers(-4000, 4000, 500) / 8, rng.integers(0, 10**6, 300) / 1000 + 0.0005, rng.normal(0, 1e13, 50), [0.0, -0.0, 1e-300, 1.005, 2.5, 0.5, 1e15 + 0.5]])]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    for digits in (0, 1, 2, 3):
        got = {r[0]: r[1] for r in df.select("x", numbers.exact_half_even(digits)(F.col("x"))).collect() if r[0] is not None and r[0] == r[0]}
        assert all(got[v] == float(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)) for v in values)


def test_scalars(spark):
    assert one(spark, wind.compass(F.lit(None).cast("double"))) is None and one(spark, wind.compass(F.lit(349.0))) == "N"
    assert one(spark, wind.in_arc(F.lit(5.0), 350.0, 30.0)) and not one(spark, wind.in_arc(F.lit(40.0), 350.0, 30.0))
    assert one(spark, numbers.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, numbers.iterated_power(2, F.lit(-3))) == 0.125 and one(spark, numbers.iterated_power(10, F.lit(2))) == 100.0
    assert one(spark, air.stability(F.lit(None).cast("double"))) is None and one(spark, air.stability(F.lit(0.0))) == "stable"
    assert one(spark, air.smoke_transmittance(F.lit(1.0), F.lit(-0.1))) == 1.0
    assert one(spark, times.offset_minutes(F.lit("-08:30"))) == -510 and one(spark, times.offset_minutes(F.lit("8:00"))) is None
    assert one(spark, numbers.nice_step(F.lit(37.0), 5)) == 10.0


def test_local_hours_over_daylight_saving(spark):
    for day, hour, want in (("2026-03-08", 2, "2026-03-08 10:00:00"), ("2026-11-01", 1, "2026-11-01 08:00:00"), ("2026-07-01", 12, "2026-07-01 19:00:00")):
        got = one(spark, times.local_instant(F.lit(day), hour, "America/Vancouver").cast("string"))
        assert got == want


def test_sun(spark):
    day = F.lit("2026-06-21").cast("date")
    rise, down = (one(spark, sun.sun_event(day, F.lit(49.25), F.lit(-123.1), s)) for s in (False, True))
    assert abs(rise - 12.12) < 0.05 and abs(down - 28.36) < 0.05  # 05:07 and 21:21 in Vancouver
    assert one(spark, sun.sun_event(day, F.lit(80.0), F.lit(0.0), True)) is None


def test_peaks_take_the_first_and_skip_nan(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, float("nan")), (5, None)], "i int, v double")
    assert df.agg(sequences.first_wins_max(F.col("v"), F.col("i"), F.col("i")).alias("x")).head()["x"] == 2
    assert df.agg(sequences.first_wins_max(F.col("v"), F.col("i"), F.col("i"), smallest=True).alias("x")).head()["x"] == 1


def test_gap_at_exactly_the_tolerance_is_none(spark):
    rows = [(1, i, T0 + dt.timedelta(minutes=m), 1.0) for i, m in enumerate((0, 25, 51))]
    h = spark.createDataFrame(rows, "station_id int, seq int, observed_at timestamp, wind_avg_mps double")
    assert station.gaps(h, 10).count() == 1 and station.runs(h, 10).select("run_id").distinct().count() == 2


def test_nearest_join_takes_the_earlier_of_ties(spark):
    left = spark.createDataFrame([(1, 1, T0)], "k int, _left int, at timestamp")
    right = spark.createDataFrame([(1, 2, T0 + dt.timedelta(minutes=10)), (1, 1, T0 - dt.timedelta(minutes=10)), (1, 3, T0 + dt.timedelta(hours=2))], "k int, seq int, ts timestamp")
    (r,) = sequences.nearest_join(left, right, "k", "at", "ts", "seq", 1800).collect()
    assert (r["r_seq"], r["offset_minutes"]) == (1, 10.0)


HOURS = "profile_id int, hour_id int, valid_at timestamp, launch_m double, day string, local_hour int, usable_lift_top_m double, thermal_velocity_mps double"


def profile(spark, tops, step_h=1):
    rows = [(1, i, T0 + dt.timedelta(hours=i * step_h), 1000.0, "2026-07-01", 5 + i, t, 1.5) for i, t in enumerate(tops)]
    return findings.prepared(spark.createDataFrame(rows, HOURS))


def test_windows_bridge_short_gaps_only_if_published(spark):
    tops = [1500.0, 1100.0, 1500.0, None, 1500.0]
    count = lambda t: findings.thermal_windows(profile(spark, tops), t).count()
    assert count(findings.DEFAULTS) == 3 and count(findings.DEFAULTS.override(max_gap_hours=1.0)) == 2
    with pytest.raises(ValueError, match="no such"):
        findings.DEFAULTS.override(nothing=1)


def test_steps_of_single_and_widening_hours(spark):
    assert [(r["before_h"], r["after_h"]) for r in profile(spark, [None]).collect()] == [(1.0, 1.0)]
    rows = [(1, i, T0 + dt.timedelta(hours=h), 0.0, "d", 0, None, None) for i, h in enumerate((0, 1, 4))]
    got = findings.prepared(spark.createDataFrame(rows, HOURS)).orderBy("hour_index").collect()
    assert [(r["before_h"], r["after_h"]) for r in got] == [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0)]


def test_lift_of_a_column_without_levels(spark):
    hours = spark.createDataFrame([(1, 500.0, 20.0, 10.0, 300.0, 50.0)], "hour_id int, model_elevation_m double, temperature_c double, dew_point_depression_c double, sensible_heat_flux_wm2 double, latent_heat_flux_wm2 double")
    none = spark.createDataFrame([], "hour_id int, height_m double, pressure_hpa double, temperature_c double, dew_point_depression_c double")
    r = derive.derived(derive.with_levels(hours, none)).head()
    assert r["boundary_layer_top_m"] is None and r["usable_lift_top_m"] is None and r["thermal_velocity_mps"] == 0.0 and r["cloud_base_m"] > 500


def test_later_line_wins_equal_generations(spark):
    lines = spark.createDataFrame([("m", T0, T0, 1), ("m", T0, T0, 2)], "model string, reference_time timestamp, generated_at timestamp, line_no int")
    (r,) = compare.keep_latest(lines, ["model", "reference_time"]).collect()
    assert (r["line_no"], r["superseded"]) == (2, 1)


def test_publication_is_idempotent_and_refuses_non_finite_numbers(spark, tmp_path):
    runs = spark.createDataFrame([("a", T0, 1.005, "é😀")], "model string, reference_time timestamp, v double, s string")
    for _ in range(2):
        publish.publish(runs, str(tmp_path / "p"), {"v": 1})
    (r,) = publish.published(spark, str(tmp_path / "p")).collect()
    assert r["v"] == 1.0 and spark.read.parquet(str(tmp_path / "p/manifest")).count() == 1
    with pytest.raises(Exception, match="non-finite number in v"):
        publish.finite_or_fail(runs.withColumn("v", F.lit(float("nan")))).collect()
    text = runs.select(publish.ascii_json(F.struct("s"))).head()[0]
    assert text.isascii() and json.loads(text) == {"s": "é😀"}
    publish.archive_lines(runs, str(tmp_path / "a"))
    publish.archive_lines(runs.withColumn("reference_time", F.lit("2026-08-03").cast("timestamp")), str(tmp_path / "a"))
    schema = "reference_time timestamp, v double, s string"
    assert publish.read_archive(spark, str(tmp_path / "a"), schema).count() == 2 and publish.read_archive(spark, str(tmp_path / "a"), schema, "2026-08-01").count() == 1


def grib(values, ni, nj, bits=12, e=0, d=1, bitmap=None, member=None):
    """A message of one field: regular grid from 50N 120W, half a degree apart, southwards."""
    section = lambda n, body: struct.pack(">IB", len(body) + 5, n) + body
    sign = lambda v, n: ((abs(v) | (1 << (8 * n - 1))) if v < 0 else v).to_bytes(n, "big")
    s1 = section(1, bytes(7) + struct.pack(">H5B", 2026, 7, 1, 12, 0, 0) + bytes(2))
    grid = b"\0" + struct.pack(">I", ni * nj) + bytes(2) + struct.pack(">H", 0) + bytes(16) + struct.pack(">II", ni, nj) + bytes(8) + sign(50_000_000, 4) + sign(240_000_000, 4) + b"\0" + sign(0, 4) + sign(0, 4) + struct.pack(">II", 500_000, 500_000) + b"\0"
    product = bytes(2) + struct.pack(">H", 0 if member is None else 1) + bytes([0, 0, 0, 0, 0]) + bytes(3) + bytes([1]) + struct.pack(">I", 6) + bytes([103]) + b"\0" + struct.pack(">I", 2) + bytes(6) + (b"" if member is None else bytes([0, member, 20]))
    present = [v for v, keep in zip(values, bitmap or [1] * len(values), strict=True) if keep]
    low = min(present)
    packed = "".join(format(round((v - low) * 10**d / 2**e), f"0{bits}b") for v in present) if bits else ""
    body = int(packed.ljust(-(-len(packed) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(packed) // 8), "big")
    s5 = section(5, struct.pack(">IH", len(present), 0) + struct.pack(">f", low * 10**d) + sign(e, 2) + sign(d, 2) + bytes([bits, 0]))
    s6 = section(6, b"\xff" if bitmap is None else b"\0" + int("".join(map(str, bitmap)).ljust(-(-len(bitmap) // 8) * 8, "0"), 2).to_bytes(-(-len(bitmap) // 8), "big"))
    rest = s1 + section(3, grid) + section(4, product) + s5 + s6 + section(7, body) + b"7777"
    return b"GRIB" + bytes(2) + b"\0\x02" + struct.pack(">Q", len(rest) + 16) + rest


def test_gridded_fields_at_sites(spark, tmp_path):
    values = [round(10 + i * 0.7, 1) for i in range(20)]
    bitmap = [0 if i == 6 else 1 for i in range(20)]
    (tmp_path / "a.grib2").write_bytes(grib(values, 5, 4) + grib(values, 5, 4, bitmap=bitmap, member=3) + grib([4.0] * 20, 5, 4, bits=0))
    sites = [("corner", 50.0, -120.0), ("hole", 49.45, -119.52), ("last", 48.3, -118.1)]
    rows = {(r["field"], r["site_id"]): r for r in gridded.sample_files(spark, str(tmp_path), sites).collect()}
    assert len(rows) == 9
    assert [rows[0, s]["value"] for s in ("corner", "hole", "last")] == pytest.approx([10.0, 14.2, 23.3])
    assert [rows[1, s]["value"] for s in ("corner", "hole", "last")] == pytest.approx([10.0, None, 23.3])
    assert rows[2, "hole"]["value"] == pytest.approx(4.0) and rows[1, "last"]["member"] == 3 and rows[0, "last"]["forecast_hours"] == 6 and rows[0, "last"]["level"] == 2.0
    assert rows[0, "corner"]["distance_m"] < 1 and rows[0, "corner"]["reference_time"] == T0
    with pytest.raises(Exception, match="outside the model's domain"):
        gridded.within(gridded.sample_files(spark, str(tmp_path), [("far", 10.0, 0.0)]), 5000.0).collect()
    for damaged in (b"junk" + grib(values, 5, 4), grib(values, 5, 4)[:-3]):
        with pytest.raises(ValueError, match="at byte"):
            list(gridded.messages(damaged))


def test_sidecar_records(spark):
    text = ["1:0:d=2026070112:TMP:2 m above ground:6 hour fcst:", "2:100:d=2026070112:UGRD:10 m above ground:6 hour fcst:", "3:100:d=2026070112:VGRD:10 m above ground:6 hour fcst:", "", "4:250:d=2026070112:MASSDEN:8 m:6 hour fcst:aerosol=x:size <1:"]
    index = gridded.sidecar(spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, line_no int, line string"))
    got = {r["variable"]: (r["start"], r["end"], r["qualifier"]) for r in index.collect()}
    assert got == {"TMP": (0, 99, ""), "UGRD": (100, 249, ""), "VGRD": (100, 249, ""), "MASSDEN": (250, None, "aerosol=x:size <1")}
    r = gridded.record(index, "TMP", "2 m above ground", "6 hour fcst").select(gridded.byte_range(F.col("start"), F.col("end"))).head()
    assert r[0] == "bytes=0-99"


def test_columnar_payloads(spark):
    good = {"t": [0, 60], "avg": [5.0, 0.2], "gust": [7.0, None], "lull": [3.0, None], "dir": [90.0, 10.0], "temp": [20.0, None]}
    raw = [(1, json.dumps(good)), (2, json.dumps(good | {"avg": [500.0, 1.0]})), (3, json.dumps(good | {"dir": [1.0]})), (4, "{"), (5, None)]
    rows = vendors.columnar_records(spark.createDataFrame(raw, "station_id int, body string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["station_id"], []).append(r)
    assert [(r["wind_avg_mps"], r["wind_direction_deg"]) for r in by[1]] == [(5.0, 90.0), (0.2, None)]
    assert by[2][0]["problem"] == "implausible wind" and by[2][0]["wind_avg_mps"] is None and by[3][0]["problem"] == "uneven columns" and by[4][0]["problem"] == by[5][0]["problem"] == "unreadable"


def leaves(**sections):
    return {k: {n: {"time": "60", "unit": "", "value": v} for n, v in s.items()} for k, s in sections.items()}


def test_text_leaves(spark):
    wind = {"wind_speed": "4.5", "wind_direction": "360", "wind_gust": "7.1"}
    good = leaves(wind=wind, outdoor={"temperature": "20.5", "humidity": "45"}, rainfall_piezo={"rain_rate": "1.5"}, rainfall={"rain_rate": "9.9", "daily": "3"}, pressure={"absolute": "950"}, battery={"haptic_array_battery": "3.1"})
    bodies = [
        {"code": 0, "data": good},
        {"code": 0, "data": leaves(wind=wind | {"wind_speed": "0.2"}, rainfall_piezo={}, rainfall={"rain_rate": "2"})},
        {"code": 0, "data": good | {"wind": {}}},
        {"code": -1, "msg": "busy", "data": []},
        {"code": 45001, "msg": "busy", "data": []},
        {"code": 40012, "msg": "Illegal Mac/Imei", "data": []},
        {"code": 0, "data": leaves(wind=wind | {"wind_speed": "500"})},
        {"code": 0, "data": leaves(wind=wind, outdoor={"humidity": "101"})},
        {"msg": "no code"},
    ]
    raw = [(i, json.dumps(b), 500.0) for i, b in enumerate(bodies)] + [(90, "{", 500.0), (91, None, None)]
    r = {x["station_id"]: x for x in vendors.text_leaves(spark.createDataFrame(raw, "station_id int, body string, elevation_m double")).collect()}
    assert [r[i]["problem"] for i in range(9)] == [None, None, "upstream_error", "rate_limited", "rate_limited", "upstream_error", "contract_break", "contract_break", "contract_break"]
    assert r[90]["problem"] == r[91]["problem"] == "contract_break" and "Illegal Mac/Imei" in r[5]["message"] and "40012" in r[5]["message"]
    assert (r[0]["wind_avg_mps"], r[0]["wind_direction_deg"], r[0]["precipitation_rate_mm_hr"], r[0]["precipitation_today_mm"], r[0]["battery_v"]) == (4.5, 0.0, 1.5, None, 3.1)
    assert r[0]["sea_level_pressure_hpa"] > 1000 and r[0]["observed_at"].timestamp() == 60
    assert r[1]["wind_direction_deg"] is None and r[1]["precipitation_rate_mm_hr"] == 2.0 and r[1]["temperature_c"] is None
    assert all(r[i]["wind_avg_mps"] is None and r[i]["observed_at"] is None for i in (2, 3, 6, 7, 90))


def test_service_states_and_failure_reasons(spark):
    states = {"LIVE": "active", "LIVE-PENDING": "active", "PAUSED-USER": "paused", "DEAD-PENDING": "retired", "INACTIVE": "inactive", "FACTORY": "inactive", "TEST-HIBERNATE": "inactive", "SOMETHING": "unknown", "": "unknown", None: "unknown"}
    df = spark.createDataFrame([(s, v) for s, v in states.items()], "s string, want string")
    assert df.where(vendors.service_state(F.col("s")) != F.col("want")).count() == 0
    assert one(spark, vendors.real_time(F.lit("0000-00-00 00:00:00"))) is None
    errors = [("UpstreamError", "rate_limited", "rate_limited"), ("UpstreamError", None, "upstream_error"), ("AbortError", None, "timeout"), ("TimeoutError", None, "timeout"), ("TypeError", None, "upstream_error"), ("ZodError", None, "contract_break"), ("Error", "rate", "contract_break"), (None, None, "contract_break")]
    df = spark.createDataFrame(errors, "kind string, carried string, want string")
    assert df.where(vendors.failure_reason(F.col("kind"), F.col("carried")) != F.col("want")).count() == 0


def test_a_failed_publication_leaves_nothing_double_and_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "p")
    first = spark.createDataFrame([("a", T0, 1.0)], "model string, reference_time timestamp, v double")
    second = first.withColumn("reference_time", F.col("reference_time") + F.expr("interval 6 hours")).withColumn("v", F.lit(2.0))
    publish.publish(first, path)
    # what a failure between the runs and the manifest leaves behind
    second.withColumn("run", F.date_format("reference_time", "yyyyMMdd'T'HHmmss")).write.mode("append").partitionBy("model", "run").parquet(f"{path}/runs")
    assert [r["v"] for r in publish.published(spark, path).collect()] == [1.0]
    for _ in range(2):
        publish.publish(first.unionByName(second), path)
        assert sorted(r["v"] for r in publish.published(spark, path).collect()) == [1.0, 2.0]


def hourly(spark, hours, extra=()):
    at = [(1, i, BASE + i * 3600) for i in range(hours)] + [(1, 1000 + i, BASE + s) for i, s in enumerate(extra)]
    return spark.createDataFrame(at, "station_id int, seq int, s long").withColumn("observed_at", F.timestamp_seconds("s"))


BASE = 1_780_000_000


def test_compare_window(spark):
    count = lambda h, *a: station.compare_window(h, *a).head()["then_n"]
    assert count(hourly(spark, 100), 6, 1) == 7
    assert count(hourly(spark, 10), 6, 1) is None
    dense = spark.createDataFrame([(1, i, BASE + i * 60) for i in range(361)] + [(1, 999, BASE + 360 * 60 - 27 * 3600)], "station_id int, seq int, s long").withColumn("observed_at", F.timestamp_seconds("s"))
    assert count(dense, 6, 1) is None
    assert count(hourly(spark, 100), 100, 1) is None


def test_benched_members_neither_vote_nor_abstain(spark):
    covered = spark.createDataFrame([(1, m, d) for m, d in ((0, "d1"), (1, "d1"), (1, "d2"), (2, "d1"))], "site int, member int, day string")
    windows = spark.createDataFrame([(1, 0, "d1", 1.2, 500.0), (1, 1, "d1", 1.0, 350.0)], "site int, member int, day string, peak_wstar_mps double, peak_above_launch_m double")
    quiet = spark.createDataFrame([(1, 2, "d1", False, 0.5, 100.0)], "site int, member int, day string, truncated boolean, peak_wstar_mps double, peak_depth_m double")
    rows = {r["day"]: r for r in compare.window_agreement(covered, windows, quiet).collect()}
    assert (rows["d1"]["voters"], rows["d1"]["unanimous"], rows["d1"]["wstar_flip_at_mps"], rows["d1"]["depth_flip_at_m"], rows["d2"]["abstained"]) == (3, False, 1.0, 350.0, 2)
    bench = compare.benched(spark.createDataFrame([(1, 2, False, 400.0), (1, 0, True, 400.0)], "site int, member int, ever_reaches_launch boolean, delta_m double"))
    rows = {r["day"]: r for r in compare.window_agreement(covered, windows, quiet, benches=bench).collect()}
    assert (rows["d1"]["voters"], rows["d1"]["unanimous"], rows["d1"]["abstained"], rows["d2"]["voters"], rows["d2"]["abstained"]) == (2, True, 0, 0, 1)


def test_nearest_join_meets_neighbouring_buckets(spark):
    rng = np.random.default_rng(3)
    left = [(int(k), i, BASE + int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 40_000, 200), strict=True))]
    right = [(int(k), i, BASE + int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 40_000, 60), strict=True))]
    df = lambda rows: spark.createDataFrame(rows, "k int, seq int, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["seq"]: r["r_seq"] for r in sequences.nearest_join(df(left), df(right), "k", "at", "at", "seq", 900).collect()}
    for k, i, t in left:
        near = [(abs(t - s), j) for q, j, s in right if q == k and abs(t - s) <= 900]
        assert got[i] == (min(near)[1] if near else None)


SAMPLES = "station_id long, seq long, observed_at timestamp, wind_avg_mps double"


def streamed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(SAMPLES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finished(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def some_samples():
    at = lambda s: T0 + dt.timedelta(seconds=s)
    return [[(1, i, at(30 * i), float(i)) for i in range(20)], [(1, 100, at(30), 9.0), (1, 101, at(900), 1.0), (2, 1, at(0), 2.0)], [(1, 102, at(86_400 * 5), 4.0), (2, 2, at(86_400 * 5), 3.0)]]


def test_streamed_digests_equal_the_batch(spark, tmp_path):
    parts = some_samples()
    got = finished(live.digests(streamed(spark, tmp_path, parts), 5, "1 day"), tmp_path, "digests").collect()
    whole = live.digests(spark.createDataFrame([r for p in parts for r in p], SAMPLES), 5).where(F.col("start_at") < F.lit(T0 + dt.timedelta(days=3))).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole))


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    parts = some_samples()
    got = finished(live.sessions(streamed(spark, tmp_path, parts), 3, "1 day"), tmp_path, "sessions").collect()
    whole = live.sessions(spark.createDataFrame([r for p in parts for r in p], SAMPLES), 3).where(F.col("started_at") < F.lit(T0 + dt.timedelta(days=3))).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole))


def test_rolling_state_equals_the_batch_window(spark, tmp_path):
    parts = some_samples()[:2]
    out = finished(live.rolling_updates(streamed(spark, tmp_path, parts)), tmp_path, "rolling", "update").collect()
    last = {}
    for r in out:
        last[r["station_id"]] = max(last.get(r["station_id"], (dt.datetime.min,)), (r["newest_at"], r["n"], r["mean_mps"]))
    batch = live.rolling_window(spark.createDataFrame([r for p in parts for r in p], SAMPLES)).groupBy("station_id").agg(F.max("observed_at").alias("a"), F.count("*").alias("n"), F.avg("wind_avg_mps").alias("m"))
    assert last == {r["station_id"]: (r["a"], r["n"], pytest.approx(r["m"])) for r in batch.collect()}


def test_first_arrivals_of_a_stream(spark, tmp_path):
    parts = some_samples()[:2]
    got = finished(live.first_arrivals(streamed(spark, tmp_path, parts)), tmp_path, "first")
    assert got.count() == 22 and got.where("seq = 100").count() == 0


def test_widest_separation_without_all_pairs(spark):
    import random

    from ridgelift.operators import compare

    r = random.Random(4)
    rows = [(g, o, round(r.random() * 360, r.choice((0, 3)))) for g in range(12) for o in range(g + 1)]
    rows += [(50, 3, 10.0), (50, 1, 10.0), (50, 2, 10.0), (51, 1, 0.0), (51, 2, 170.0), (51, 3, 190.0), (52, 1, None), (52, 2, 5.0)]
    rows += [(60, o, float(o * 7 % 360)) for o in range(200)]
    want = {}
    for g, o, d in rows:
        for h, q, e in rows:
            if g == h and o < q and None not in (d, e):
                want[g] = min(want.get(g, (999,)), (abs(abs(d - e) - 180), o, q))
    df = compare.widest_separation(spark.createDataFrame(rows, "k long, ord long, deg double"), "k")
    assert {x[0]: (180 - x[1], x[2], x[3]) for x in df.collect()} == {g: (180 - (180 - w[0]), w[1], w[2]) for g, w in want.items()}
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_quantiles_make_no_array_of_a_stations_values(spark):
    from ridgelift.plans import catalogue

    for name in ("a27_a30_a31_small_statistics", "a28_a32_quantiles"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        assert "collect_list" not in df._jdf.queryExecution().toString()
