"""Vendors' live events as frames, and their fold as a stream: any cut into batches gives what the batch twin gives."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from ridgelift.plans import catalogue
from ridgelift.plans.live import live_events
from ridgelift.sources import live_frames
from ridgelift.streaming import live

EVENTS = "station_id long, seq long, event string, data string, has_temperature boolean, has_pressure boolean, has_battery boolean, elevation_m double, served_at timestamp"
NOON = dt.datetime(2026, 7, 1, 12)
SF = "/root/testdata/sf0.001"


def at(s):
    return (NOON + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(**over):
    return {"recent": {"date_utc": at(0), "wind_avg_2D": 3.0, "wind_dir": 360, "temperature": 20, "pressure_hpa": 900.0, "voltage": 12.5} | over}


def event(seq, body, station=1, name="message", flags=(True, True, True)):
    return (station, seq, name, body if body is None or isinstance(body, str) else json.dumps(body), *flags, 500.0, NOON + dt.timedelta(seconds=seq))


def frames_of(spark, rows):
    return live_frames.frames(spark.createDataFrame(rows, EVENTS))


def test_frames(spark):
    step = {"wind_avg_1D": 0.2, "wind_dir": 90, "wind_max": 4}
    blocks = {"last_10mn_by_1mn": [None, step | {"wind_min": 999}, step], "last_60mn_by_5mn": [step, {"wind_dir": 5}]}
    place = {"guessed_position": {"lat": 49.5, "lon": "x"}, "altitude": 700, "timezone": "", "standard_timeoffset": "-08:00", "location_type_meta": {"dir_ranges": [{"from": 10, "to": 20}]}}
    samples = [{"ts": at(3), "sp": 4.0, "dir": 361 - 1}, None, {"ts": at(0), "sp": 0.1, "dir": 5}]
    rows = [
        event(0, {"type": "INIT", "delay": 3, "digest": digest() | blocks, "samples": samples, "location": place}),
        event(1, None, name="ping"),
        event(2, {"type": "LAST_DIGEST", **digest(temperature=None)}, flags=(True, True, False)),
        event(3, {"type": "LAST_DIGEST", **digest(), **blocks}, flags=(False, False, False)),
        event(4, {"type": "WIND_SAMPLES", "samples": []}),
        event(5, {"type": "TOMORROW", "samples": 5}),
        event(6, "{}", name="settings"),
    ]
    got = {(r["seq"], r["part"]): r for r in frames_of(spark, rows).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {(0, 0): "init", (1, 0): "ping", (2, 0): "reading", (3, 0): "reading", (3, 1): "summaries", (4, 0): "samples"}
    init = got[0, 0]
    assert [(s["observed_at"], s["wind_mps"], s["wind_direction_deg"]) for s in init["samples"]] == [(NOON, 0.1, None), (NOON + dt.timedelta(seconds=3), 4.0, 0.0)]
    assert [(b["window_minutes"], [(p["observed_at"], p["wind_gust_mps"], p["wind_lull_mps"], p["wind_direction_deg"]) for p in b["points"]]) for b in got[3, 1]["summaries"]] == [(10, [(NOON - dt.timedelta(minutes=1), 4.0, None, None), (NOON, 4.0, None, None)])]
    assert (init["place"]["latitude"], init["place"]["longitude"], init["place"]["time_zone"], init["place"]["standard_offset_minutes"], init["place"]["delay_s"], init["place"]["favourable"][0]["to_deg"]) == (49.5, None, None, -480, 3.0, 20.0)
    assert got[2, 0]["reading"]["temperature_c"] is None and got[2, 0]["reading"]["battery_v"] is None and got[2, 0]["reading"]["wind_direction_deg"] == 0.0
    assert got[3, 0]["reading"]["temperature_c"] is None and got[3, 0]["reading"]["sea_level_pressure_hpa"] is None and got[4, 0]["samples"] == []


@pytest.mark.parametrize(
    ("body", "problem"),
    [
        ("{", "unreadable"),
        ("[]", "unreadable"),
        ("7", "unreadable"),
        ({"type": "LAST_DIGEST"}, "digest"),
        ({"type": "LAST_DIGEST", **digest(date_utc="noon")}, "digest time"),
        ({"type": "LAST_DIGEST", **digest(wind_avg_2D=None)}, "wind average"),
        ({"type": "LAST_DIGEST", **digest(wind_avg_2D="3")}, "wind_avg_2D"),
        ({"type": "LAST_DIGEST", **digest(wind_avg_2D=141)}, "wind_avg_2D"),
        ({"type": "LAST_DIGEST", **digest(wind_dir=None)}, "wind_dir"),
        ({"type": "LAST_DIGEST", **digest(wind_dir=361)}, "wind_dir"),
        ({"type": "LAST_DIGEST", **digest(pressure_hpa=20)}, "pressure_hpa"),
        ({"type": "LAST_DIGEST", **digest(voltage="full")}, "voltage"),
        ({"type": "INIT", "digest": digest()}, "samples"),
        ({"type": "WIND_SAMPLES", "samples": [{"ts": at(0), "sp": -1, "dir": 0}]}, "sample"),
        ({"type": "WIND_SAMPLES", "samples": [{"ts": "x", "sp": 1, "dir": 0}]}, "sample"),
        ({"type": "WIND_SAMPLES", "samples": {}}, "samples"),
    ],
)
def test_broken_frames(spark, body, problem):
    (r,) = frames_of(spark, [event(0, body)]).collect()
    assert (r["kind"], r["problem"], r["reading"], r["samples"]) == ("broken", problem, None, None)


def test_the_batch_reads_its_frames_twice(spark):
    """Once for what is carried, once for the samples; each reads a message once with either schema, and no join looks for the init first."""
    plan = catalogue.queries()["st01_st05_live_frames"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("from_json(") <= 4 + 6  # the rest reads the few stations' own texts


def test_what_is_older_than_the_init_is_not_carried(spark):
    """And without an init nothing is, however many readings there are."""
    other = {"type": "LAST_DIGEST", **digest(wind_avg_2D=9.0), "last_10mn_by_1mn": [{"wind_avg_1D": 8.0, "wind_dir": 90}]}
    init = {"type": "INIT", "digest": digest(), "samples": [{"ts": at(0), "sp": 1.0, "dir": 10}]}
    rows = [event(1, other), event(5, init), event(7, {"type": "LAST_DIGEST", **digest(wind_avg_2D=4.0)}), event(1, other, station=2), event(2, "{", station=2)]
    got = {r["station_id"]: r for r in live.frame_snapshots(frames_of(spark, rows), 600).collect()}
    assert got[1]["reading"]["wind_avg_mps"] == 4.0 and got[1]["summaries"] is None and [s["wind_mps"] for s in got[1]["samples"]] == [1.0]
    assert (got[2]["reading"], got[2]["summaries"], got[2]["samples"], got[2]["status"], got[2]["error"]) == (None, None, [], "open", "network")


def rows_of(df):
    return {r["station_id"]: (r["seq"], r["status"], r["error"], r["served_at"], r["reading"], r["summaries"], r["place"], r["samples"]) for r in df.collect()}


def fed(spark, path, parts):
    for name, rows in parts:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/in/{name}")
    return live_frames.frames(spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))


def run_to_end(updates, path):
    """Runs what there is; appends the updates to a table with the number of their batch."""
    q = updates.writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}/out")).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def newest(spark, path):
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy("station_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("station_id", "batch")]), "batch").alias("s")).select("station_id", "s.*")


@pytest.fixture
def rocks(spark):
    settings = dict([live.STATE_STORE, live.NO_IDLE_BATCHES, ("spark.sql.shuffle.partitions", "2")])
    before = {k: spark.conf.get(k) for k in settings}
    for values in (settings, before):
        for k, v in values.items():
            spark.conf.set(k, v)
        if values is settings:
            yield spark


@pytest.mark.parametrize("cuts", [(), (40, 41, 90)])
def test_any_cut_equals_the_batch(rocks, tmp_path, cuts):
    """The stream starts again from its checkpoint after every part of its input."""
    rows = [tuple(r) for r in live_events(rocks, SF).where("station_id < 12").orderBy("seq").limit(150).select(*[c.split()[0] for c in EVENTS.split(", ")]).collect()]
    want = rows_of(live.frame_snapshots(frames_of(rocks, rows), 48 * 3600))
    bounds = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        stream = fed(rocks, tmp_path, [(f"{i:03d}", rows[a:b])] if a < b else [])
        run_to_end(live.snapshot_updates(stream, 48 * 3600), tmp_path)
    got = newest(rocks, tmp_path)
    for station, row in rows_of(got).items():
        for ours, theirs in zip(row, want[station], strict=True):
            assert ours == theirs
    assert len(want) > 5 and got.count() == len(want) and got.where("late > 0").count() == 0
    assert {v[1] for v in want.values()} >= {"open"} and any(v[2] for v in want.values())


def test_late_frames_and_silence(rocks, tmp_path):
    init = {"type": "INIT", "digest": digest(), "samples": [{"ts": at(0), "sp": 1.0, "dir": 10}]}
    parts = [
        [event(5, init), event(6, {"type": "WIND_SAMPLES", "samples": [{"ts": at(700), "sp": 2.0, "dir": 20}]})],
        [event(4, {"type": "LAST_DIGEST", **digest(wind_avg_2D=9.0)}), event(6, "{")],
        [event(1, init, station=2)],
        [event(2, None, station=3, name="ping")],
    ]
    for i, rows in enumerate(parts):
        stream = fed(rocks, tmp_path, [(str(i), rows)])
        if i >= 2:
            time.sleep(2.5)
        run_to_end(live.snapshot_updates(stream, 600, idle_seconds=2, forget_seconds=2), tmp_path)
    seen = {}
    for r in rocks.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
        seen.setdefault(r["station_id"], []).append(r)
    one = seen[1]
    assert [(r["seq"], r["late"], r["error"]) for r in one[:2]] == [(6, 0, None), (6, 2, None)]
    assert one[1]["reading"]["wind_avg_mps"] == 3.0 and [s["wind_mps"] for s in one[1]["samples"]] == [2.0]
    assert [r["error"] for r in one[2:]] == ["timeout"] and one[2]["reading"]["wind_avg_mps"] == 3.0
    assert seen[3][0]["status"] == "connecting" and seen[3][0]["samples"] == []
