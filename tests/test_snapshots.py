"""A reader sees one publication across all families, whatever is published while it reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgelift.operators import snapshots

T0 = dt.datetime(2026, 7, 1)


def forecast(spark, run, sites=("a", "b")):
    at = T0 + dt.timedelta(hours=run)
    return spark.createDataFrame([(s, "m", at, at, at + dt.timedelta(hours=h), float(run)) for s in sites for h in (0, 1)], snapshots.FAMILIES["forecast"] + ", lift_top_m double")


def runs(spark, run):
    at = T0 + dt.timedelta(hours=run)
    return spark.createDataFrame([("m", at, at), ("m", T0, at)], snapshots.FAMILIES["runs"])


def observation(spark, value):
    return spark.createDataFrame([("a", T0, "x", value)], snapshots.FAMILIES["observation"])


def test_a_reader_stays_with_its_publication(spark, tmp_path):
    path = str(tmp_path)
    assert snapshots.open_snapshot(spark, path) is None
    assert snapshots.publish(spark, path, {"forecast": forecast(spark, 1), "runs": runs(spark, 1), "observation": observation(spark, 1.0)}) == 1
    first = snapshots.open_snapshot(spark, path)
    rows = first.load("forecast")
    assert rows.agg(F.max("lift_top_m")).head()[0] == 1.0
    assert snapshots.publish(spark, path, {"forecast": forecast(spark, 6, ("a",)), "runs": runs(spark, 6)}) == 2
    assert (first.load("forecast").count(), first.reference_times().head()["reference_time"], rows.count()) == (4, T0 + dt.timedelta(hours=1), 4)
    second = snapshots.open_snapshot(spark, path)
    assert (second.version, second.load("forecast").count(), second.reference_times().head()["reference_time"]) == (2, 2, T0 + dt.timedelta(hours=6))
    assert second.load("observation").head()["value"] == 1.0 and second.families == {"forecast": 2, "runs": 2, "observation": 1}
    assert second.site("forecast", "b").count() == 0 and first.site("forecast", "b").count() == 2
    assert snapshots.open_snapshot(spark, path, 1).families == first.families and snapshots.open_snapshot(spark, path, 9) is None
    assert second.load("smoke") is None and second.site("smoke", "a") is None


def test_a_publication_that_fails_is_invisible(spark, tmp_path):
    path = str(tmp_path)
    snapshots.publish(spark, path, {"forecast": forecast(spark, 1), "runs": runs(spark, 1)})
    broken = observation(spark, 2.0).withColumn("value", F.lit(float("inf")))
    with pytest.raises(Exception, match="non-finite"):
        snapshots.publish(spark, path, {"forecast": forecast(spark, 6), "observation": broken})
    seen = snapshots.open_snapshot(spark, path)
    assert (seen.version, seen.load("forecast").agg(F.max("lift_top_m")).head()[0], seen.load("observation")) == (1, 1.0, None)
    assert snapshots.publish(spark, path, {"forecast": forecast(spark, 7), "observation": observation(spark, 3.0)}) == 2
    seen = snapshots.open_snapshot(spark, path)
    assert (seen.load("forecast").agg(F.max("lift_top_m")).head()[0], seen.load("observation").head()["value"], seen.load("runs").count()) == (7.0, 3.0, 2)


def test_contracts_of_families(spark, tmp_path):
    path = str(tmp_path)
    for rows, told in ((observation(spark, 1.0).drop("source"), "lacks source"), (observation(spark, 1.0).withColumn("value", F.col("value").cast("string")), r"has value \(string\)")):
        with pytest.raises(ValueError, match=told):
            snapshots.publish(spark, path, {"observation": rows})
    with pytest.raises(ValueError, match="no family"):
        snapshots.publish(spark, path, {"tides": observation(spark, 1.0)})
    assert snapshots.open_snapshot(spark, path) is None
    snapshots.publish(spark, path, {"observation": observation(spark, 1.0)})
    observation(spark, 1.0).drop("value").write.mode("overwrite").parquet(f"{path}/observation/version=1")
    with pytest.raises(ValueError, match="version 1: observation lacks value"):
        snapshots.open_snapshot(spark, path).load("observation")
    with pytest.raises(ValueError, match="no family"):
        snapshots.open_snapshot(spark, path).load("tides")


def test_runs_within_one_second(spark, tmp_path):
    from ridgelift.operators import publish

    path = str(tmp_path / "p")
    a = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + dt.timedelta(microseconds=5), 2.0)], "model string, reference_time timestamp, v double")
    publish.publish(a.limit(1), path)
    publish.publish(a, path)
    assert sorted(r["v"] for r in publish.published(spark, path).collect()) == [1.0, 2.0]
