"""Vendors' tables, wall clock times, catalogues and indexes: small cases with known answers."""

import datetime as dt
import json
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from ridgelift.functions import times
from ridgelift.operators import documents, hours, nights, texts
from ridgelift.sources import vendors

UTC = dt.timezone.utc
ZONE = "America/Vancouver"


def seconds(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())


def test_wall_clock_times(spark):
    cases = [
        ("2026-07-01T12:00:00", None, seconds("2026-07-01T19:00:00")),
        ("2026-11-01T01:30:00", None, seconds("2026-11-01T08:30:00")),  # comes twice: the first
        ("2026-11-01T01:30:00", seconds("2026-11-01T08:30:00"), seconds("2026-11-01T09:30:00")),
        ("2026-11-01T01:30:00", seconds("2026-11-01T10:00:00"), seconds("2026-11-01T09:30:00")),
        ("2026-03-08T02:30:00", None, seconds("2026-03-08T10:00:00")),  # never comes: the change itself
        ("2026-02-30T00:00:00", None, None),
        ("yesterday", None, None),
    ]
    df = spark.createDataFrame([(t, a, i) for i, (t, a, _) in enumerate(cases)], "t string, a long, i int")
    got = {r["i"]: r["s"] for r in df.select("i", times.naive_instant(F.col("t"), ZONE, after_s=F.col("a")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]
    near = df.where("i in (0, 1)").select("i", times.naive_instant(F.col("t"), ZONE, near_s=F.lit(seconds("2026-11-01T09:20:00"))).alias("s"))
    assert {r["i"]: r["s"] for r in near.collect()} == {0: cases[0][2], 1: seconds("2026-11-01T09:30:00")}
    every = [seconds("2026-01-01T00:00:00") + 3571 * k for k in range(0, 8700, 29)]
    texts = [(dt.datetime.fromtimestamp(s, ZoneInfo(ZONE)).strftime("%Y-%m-%dT%H:%M:%S"), s) for s in every]
    back = spark.createDataFrame(texts, "t string, s long").withColumn("got", times.naive_instant(F.col("t"), ZONE, near_s=F.col("s")))
    assert back.where("got != s").count() == 0


def test_odd_changes_of_clocks(spark):
    cases = [
        ("Pacific/Apia", "2011-12-30T12:00:00", "2011-12-30T10:00:00"),  # a whole day that never comes
        ("Pacific/Apia", "2011-12-31T00:00:00", "2011-12-30T10:00:00"),
        ("Australia/Lord_Howe", "2026-04-05T01:45:00", "2026-04-04T14:45:00"),  # half an hour comes twice
        ("Australia/Lord_Howe", "2026-10-04T02:15:00", "2026-10-03T15:30:00"),
        ("UTC", "2026-03-08T02:30:00", "2026-03-08T02:30:00"),
        ("Europe/Vienna", "2000-01-01T00:00:00", "1999-12-31T23:00:00"),
    ]
    for zone, text, want in cases:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(times.naive_instant(F.col("t"), zone)).head()[0] == seconds(want)
    assert spark.createDataFrame([("2500-01-01T00:00:00",)], "t string").select(times.naive_instant(F.col("t"), ZONE)).head()[0] is None


def test_character_references(spark):
    cases = {"&#60;&#x3C;&#X3c;&#0060;": "<<<<", "&amp;lt; &amp;#60;": "&lt; &#60;", "&#128169;&#x1F4A9;é": "💩💩é", "&#xD800;&#0;&#1114112;&nope;&": "&#xD800;&#0;&#1114112;&nope;&", "": "", "a\n&apos;": "a\n'"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", texts.decoded_xml(F.col("t"))).collect()} == cases


def table_body(fields=None, times_=("2026-11-01T00:30:00", "2026-11-01T01:30:00", "2026-11-01T01:30:00"), **over):
    fields = fields or [{"name": n, "process": p, "type": "xsd:float", "units": u} for n, p, u in vendors.HISTORY_FIELDS]
    vals = [[10.0, 361.0 - 1, 36.0, 18.0, 7.2], [9.0, 90.0, 36.0, 1.0, 0.0], [8.0, 90.0, 36.0, 18.0, 0.0]]
    body = {"more": False, "head": {"environment": {"table_name": "Wind"}, "fields": fields}, "data": [{"time": t, "vals": v} for t, v in zip(times_, vals, strict=False)]}
    return json.dumps(body | over)


def test_logger_table(spark):
    renamed = [{"name": n, "process": p, "type": "xsd:float", "units": "knots" if n == "WS_kph_Avg" else u} for n, p, u in vendors.HISTORY_FIELDS]
    bodies = [table_body(), table_body(more=True), table_body(renamed), table_body(times_=("noon",)), "{", None]
    raw = spark.createDataFrame([(i, "Wind", b) for i, b in enumerate(bodies)] + [(9, "Other", table_body())], "station_id int, table_name string, body string")
    rows = {}
    for r in vendors.logger_table(raw, ZONE).orderBy("station_id", "place").collect():
        rows.setdefault(r["station_id"], []).append(r)
    assert [r["observed_at"].replace(tzinfo=None) for r in rows[0]] == [dt.datetime(2026, 11, 1, 7, 30), dt.datetime(2026, 11, 1, 8, 30), dt.datetime(2026, 11, 1, 9, 30)]
    assert rows[0][0]["wind_avg_mps"] == pytest.approx(5.0) and rows[0][0]["wind_direction_deg"] == 0.0 and rows[0][1]["wind_direction_deg"] is None and rows[0][2]["temperature_c"] == 8.0
    assert {i: rows[i][0]["problem"] for i in (1, 2, 3, 4, 5, 9)} == {1: "incomplete", 2: "fields changed", 3: "records", 4: "incomplete", 5: "incomplete", 9: "wrong table"}


def test_single_observation(spark):
    obs = {"timestamp": 60, "wind_avg": 4.0, "wind_direction": 360, "wind_gust": 6.0, "air_temperature": 12.5, "precip": 0.1, "relative_humidity": 55}
    bodies = [{"station_id": 7, "elevation": 300.0, "obs": [obs]}, {"station_id": 8, "obs": [obs]}, {"station_id": 7, "obs": []}, {"station_id": 7, "obs": [obs | {"wind_gust": 400}]}, {"station_id": 7, "obs": [{k: v for k, v in obs.items() if k != "air_temperature"}]}, {"station_id": 7, "obs": [obs | {"relative_humidity": 101}]}, {"station_id": 7, "obs": [obs | {"wind_avg": 0.1}]}]
    raw = spark.createDataFrame([(i, 7, json.dumps(b)) for i, b in enumerate(bodies)], "station_id int, expected_id int, body string")
    r = {x["station_id"]: x for x in vendors.single_observation(raw).collect()}
    assert [r[i]["problem"] for i in range(7)] == [None, *["contract_break"] * 5, None]
    assert r[0]["precipitation_rate_mm_hr"] == pytest.approx(6.0) and r[0]["wind_direction_deg"] == 0.0 and r[0]["elevation_m"] == 300.0 and r[1]["wind_avg_mps"] is None and r[6]["wind_direction_deg"] is None


def test_config_goes_before_the_vendor(spark):
    config = spark.createDataFrame([(1, 10.0, None), (2, None, None)], "station_id int, latitude double, zone string")
    vendor = spark.createDataFrame([(1, 99.0, "A")], "station_id int, latitude double, zone string")
    assert sorted(map(tuple, vendors.enriched(config, vendor, ("latitude", "zone")).collect())) == [(1, 10.0, "A"), (2, None, None)]


def test_strict_sites(spark):
    site = {"slug": "big-hill", "name": "Big Hill", "latitude": 50.5, "longitude": -120.25}
    good = {"schemaVersion": 2, "sites": [site, site | {"slug": "Big Hill"}, site | {"elevationM": 900}, {k: v for k, v in site.items() if k != "name"}, site | {"zz": 1, "aa": 2}]}
    bodies = [good, {"schemaVersion": 1, "sites": [site]}, {"schemaVersion": 2, "sites": []}]
    raw = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "path int, body string")
    rows = [(r["path"], r["slug"], r["problem"]) for r in documents.strict_sites(raw, tuple(site)).collect()]
    assert [p for n, _, p in rows if n == 0] == [None, "slug", "elevation", "missing name", "unknown aa, zz"]
    assert [p for n, _, p in rows if n] == ["version", "no sites"]


def test_catalogue_and_index(spark):
    body = {"models": [{"slug": "a", "kind": "deterministic"}, {"slug": "b", "kind": "ensemble"}], "observationModels": [{"slug": "o"}]}
    raw = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert [tuple(r) for r in documents.catalogued_models(raw).collect()] == [(0, "a", "deterministic"), (1, "b", "ensemble"), (2, "o", None)]
    members = [{"byteOffset": 0, "byteLength": 10, "lines": 3, "referenceTime": "t"}, {"byteOffset": -1, "byteLength": 10}, {"byteOffset": 1.5, "byteLength": 10}, {"byteOffset": 10, "byteLength": 0}, {"byteOffset": 10, "byteLength": 5, "lines": -2}]
    raw = spark.createDataFrame([("x", json.dumps({"members": members})), ("y", json.dumps({"schemaVersion": 9, "members": members})), ("z", "{")], "path string, body string")
    assert [(r["path"], r["byteOffset"], r["lines"]) for r in documents.index_members(raw).collect()] == [("x", 0, 3), ("x", 10, None)]


def test_gusts_that_contradict_fail_the_job(spark):
    df = spark.createDataFrame([(10.0, 10.05), (None, 3.0)], "m double, i double")
    assert [r[0] for r in df.select(hours.checked_gust(F.col("m"), F.col("i"))).collect()] == [10.0, None]
    with pytest.raises(Exception, match="hour-max gust 5.00"):
        spark.createDataFrame([(5.0, 9.0)], "m double, i double").select(hours.checked_gust(F.col("m"), F.col("i"))).collect()


def test_a_day_needs_a_zone(spark):
    with pytest.raises(ValueError, match="time zone"):
        hours.project(spark.range(1), day="2026-01-01")


def test_nights(spark):
    at = dt.datetime(2026, 7, 1, 0, 0, tzinfo=UTC)
    h = spark.createDataFrame([(s, at + dt.timedelta(hours=i), 20.0 - (8.0 if i == 10 else 0.0)) for s in (1, 2, 3) for i in range(48)], "station_id int, observed_at timestamp, temperature_c double")
    places = spark.createDataFrame([(1, 49.0, -123.0), (2, None, -123.0), (3, 80.0, 0.0)], "station_id int, latitude double, longitude double")
    got = [(r["station_id"], r["from_at"], r["to_at"]) for r in nights.nights(h, places).orderBy("from_at").collect()]
    assert [s for s, _, _ in got] == [1, 1] and all(5 < (b - a).total_seconds() / 3600 < 9 for _, a, b in got)
    (low,) = nights.last_night_low(h, places, F.lit("2026-07-01 22:00:00").cast("timestamp")).collect()
    assert (low["station_id"], low["low_c"], low["from_at"]) == (1, 12.0, got[0][1])


def test_event_streams(spark):
    from ridgelift.operators import texts

    body = ": hello\nevent: init\ndata: {\"a\":1}\ndata: more\n\ndata:x\r\nid: 7\r\n\r\nevent: lost\n\nevent:\ndata\n\ndata: not ended"
    rows = [tuple(r) for r in texts.stream_events(spark.createDataFrame([("p", body)], "path string, body string")).select("event", "data", "too_long").collect()]
    assert rows == [("init", '{"a":1}\nmore', False), ("message", "x", False), ("message", "", False)]
    (r,) = texts.stream_events(spark.createDataFrame([("p", "data: " + "y" * 100 + "\n\n")], "path string, body string"), 50).collect()
    assert r["too_long"] and r["data"] is None


def test_members_and_values_that_must_be_there(spark):
    from ridgelift.operators import vertical

    rows = [(1, 0, "u", 3.0), (1, 0, "v", 4.0), (1, 1, "u", 1.0), (2, 0, "u", 0.0), (2, 0, "v", 0.0)]
    df = spark.createDataFrame(rows, "site int, member int, component string, value double")
    assert sorted((r["site"], r["member"], r["speed_mps"], r["direction_deg"]) for r in vertical.wind_pairs(df, ["site"]).collect())[1] == (2, 0, 0.0, 0.0)
    assert vertical.wind_pairs(df, ["site"], members=1).count() == 2
    with pytest.raises(Exception, match="1 of 2 members"):
        vertical.wind_pairs(df, ["site"], members=2).collect()
    with pytest.raises(Exception, match="temperature is missing"):
        spark.createDataFrame([(1.0,), (None,)], "t double").select(vertical.required(F.col("t"), "temperature")).collect()
