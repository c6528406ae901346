"""Granules from listings: instants of keys, what a run takes, and exactly-once appends."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgelift.streaming import ingest

DAY = dt.datetime(2026, 3, 1)
NOW = DAY + dt.timedelta(hours=12)


def key(minutes, tail=".nc"):
    at = DAY + dt.timedelta(minutes=minutes)
    return f"P/{at:%Y/%j/%H}/OR_P_s{at:%Y%j%H%M%S}7_e{at:%Y%j%H%M%S}0{tail}"


def page(keys):
    return "<List>" + "".join(f"<Contents><Key>{k}</Key><Size>1</Size></Contents>" for k in keys) + "</List>"


def test_instants_and_folders(spark):
    cases = {key(0): DAY, "a_s20240602359599": dt.datetime(2024, 2, 29, 23, 59, 59), "a_s20243660000000": dt.datetime(2024, 12, 31), "a_s20240002359599": None, "a_s2024060": None, "plain.nc": None, "a_s20240602459599": None}
    df = spark.createDataFrame([(k,) for k in cases], "key string")
    assert {r[0]: r[1] for r in df.select("key", ingest.scan_instant(F.col("key"))).collect()} == cases
    since, until = (F.lit(t).cast("timestamp") for t in ("2024-12-31 22:30:00", "2025-01-01 00:00:00"))
    assert spark.range(1).select(ingest.hour_folders(since, until)).head()[0] == ["2024/366/22/", "2024/366/23/", "2025/001/00/"]


def seen(spark, path):
    return sorted((r["key"], r["observed_at"]) for r in ingest.committed(spark, path).collect())


def wanted(minutes):
    return sorted((key(m), DAY + dt.timedelta(minutes=m)) for m in minutes)


def pages_of(spark, path):
    return spark.readStream.schema("path string, body string").option("recursiveFileLookup", "true").parquet(path)


def put(spark, path, name, keys):
    spark.createDataFrame([(name, page(keys)), (name, None)], "path string, body string").coalesce(1).write.parquet(f"{path}/{name}")


#: Three runs: granules after the floor (six hours before noon), some late, some listed again, one too late, one of the future, one of another kind.
RUNS = [([300, 370, 400, 400], 420), ([380, 430, 460, 370], 480), ([440, 470, 500, 465, 900], 720)]


def test_three_runs_equal_one(spark, tmp_path):
    for i, (minutes, now) in enumerate(RUNS):
        put(spark, tmp_path / "in", str(i), [key(m) for m in minutes] + [key(minutes[0], ".txt"), "odd.nc"])
        ingest.run(pages_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), lambda now=now: DAY + dt.timedelta(minutes=now))
    once = tmp_path / "once"
    ingest.run(pages_of(spark, str(tmp_path / "in")), str(once), str(tmp_path / "check-once"), lambda: DAY + dt.timedelta(minutes=720))
    want = wanted([370, 380, 400, 430, 440, 460, 465, 470, 500])
    assert seen(spark, str(once)) == want
    assert sorted(set(seen(spark, str(tmp_path / "out"))) - set(want)) == wanted([300]) and set(want) <= set(seen(spark, str(tmp_path / "out")))
    assert len(seen(spark, str(tmp_path / "out"))) == len(want) + 1  # nothing twice; the floor had not passed minute 300 in the first run
    assert ingest.cursor(spark, str(tmp_path / "out")) == DAY + dt.timedelta(minutes=500)


def test_crash_between_append_and_commit(spark, tmp_path, monkeypatch):
    path, put_path = str(tmp_path / "out"), tmp_path / "in"
    put(spark, put_path, "0", [key(m) for m in (400, 410)])
    whole = ingest._read
    calls = {"n": 0}

    def breaks(spark, where, schema):
        if "/granules/batch=" in where:
            calls["n"] += 1
            if calls["n"] == 1:
                raise RuntimeError("lost")
        return whole(spark, where, schema)

    monkeypatch.setattr(ingest, "_read", breaks)
    with pytest.raises(Exception, match="lost"):
        ingest.run(pages_of(spark, str(put_path)), path, str(tmp_path / "check"), lambda: NOW)
    assert seen(spark, path) == [] and ingest.cursor(spark, path) is None  # written, not committed
    put(spark, put_path, "1", [key(m) for m in (400, 420)])
    ingest.run(pages_of(spark, str(put_path)), path, str(tmp_path / "check"), lambda: NOW)
    assert seen(spark, path) == wanted([400, 410, 420]) and ingest.cursor(spark, path) == DAY + dt.timedelta(minutes=420)


def test_late_beyond_the_span_is_left(spark):
    listing = spark.createDataFrame([("p", page([key(m) for m in (100, 400, 650, 700)]))], "path string, body string")
    published = spark.createDataFrame([(key(700), DAY + dt.timedelta(minutes=700))], "key string, observed_at timestamp")
    assert sorted(r["key"] for r in ingest.fresh_keys(listing, published, NOW).collect()) == [key(650)]
    assert sorted(r["key"] for r in ingest.fresh_keys(listing, published.limit(0), NOW).collect()) == [key(400), key(650), key(700)]
