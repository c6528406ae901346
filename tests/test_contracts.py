"""Rosters and their breaches, extensions over one frame, windows that read only the days they need."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from ridgelift.functions import wire
from ridgelift.operators import analysis, archive, members
from ridgelift.sources import file_names

ZONE = "America/Vancouver"
SAMPLES = "field string, site_id string, member int, grid_key long, along_grid boolean, value double"


def asked(spark, rows):
    return members.rosters(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([("t",)], "field string"), spark.createDataFrame([("a",), ("b",)], "site_id string"), (0, 1, 2))


def whole(site, but=None):
    rows = {m: ("t", site, m, 7, True, 10.0 + m) for m in (0, 1, 2)}
    return [r for r in (rows | (but or {})).values() if r is not None]


@pytest.mark.parametrize(
    ("but", "problem"),
    [
        ({1: None}, "members missing: 1"),
        ({3: ("t", "b", 2, 7, True, 1.0)}, "members twice"),
        ({3: ("t", "b", 9, 7, True, 1.0)}, "members unknown: 9"),
        ({0: ("t", "b", 0, 7, True, None)}, "values missing"),
        ({0: ("t", "b", 0, 7, True, float("nan"))}, "values missing"),
        ({0: ("t", "b", 0, 8, True, 1.0)}, "several grids"),
        ({0: ("t", "b", 0, 7, False, 1.0)}, "several ways of giving wind"),
        ({0: None, 1: None, 2: None}, "nothing there"),
    ],
)
def test_breaches(spark, but, problem):
    rows = asked(spark, whole("a") + whole("b", but))
    assert {r["site_id"]: (r["values"], r["problem"]) for r in rows.collect()} == {"a": ([10.0, 11.0, 12.0], None), "b": (None, problem)}
    with pytest.raises(Exception, match=f"field t, site b: {problem}"):
        members.complete(rows).collect()


def test_complete_rosters_and_winds(spark):
    u = members.complete(asked(spark, list(reversed(whole("a") + whole("b")))))
    assert [(r["site_id"], r["values"]) for r in u.orderBy("site_id").collect()] == [("a", [10.0, 11.0, 12.0]), ("b", [10.0, 11.0, 12.0])]
    assert sorted(tuple(r) for r in members.paired_winds(u, u).collect())[:2] == [("a", 0, 10.0, 10.0), ("a", 1, 11.0, 11.0)]
    with pytest.raises(Exception, match="different grids"):
        members.paired_winds(u, u.withColumn("grid_key", F.lit(9).cast("long"))).collect()
    flags = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 2), (4.0, None)], "v double, q int")
    assert [r[0] for r in flags.select(members.gated(F.col("v"), F.col("q"), 1)).collect()] == [1.0, 2.0, None, None]


def test_one_evaluation_for_all(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measured(x):
        seen.add(1)
        return float(x)

    hours = spark.range(40).select((F.col("id") % 4).alias("profile_id"), measured(F.col("id")).alias("x"))
    top = lambda h: h.groupBy("profile_id").agg(F.max("x").alias("x"))
    more = [analysis.Extension("me/low", lambda h, _: h.groupBy("profile_id").agg(F.min("x").alias("x"))), analysis.Extension("me/told", lambda _, f: f.groupBy("profile_id").agg(F.count("*").alias("n")))]
    a = analysis.analyse(hours, {"quietDay": top, "thermalWindow": top}, more)
    assert a.findings.count() == 8 and sorted(r["statement"] for r in a.extensions.where("profile_id = 3").collect()) == ['{"n":2}', '{"x":3.0}']
    assert seen.value == 40
    a.close()
    assert analysis.analyse(hours, {"quietDay": top}).extensions.count() == 0


@pytest.mark.parametrize("names", [["low"], ["/low"], ["me/"], ["me/quietDay"], ["me/a", "you/a", "me/a"]])
def test_names_are_checked_first(spark, names):
    def never(*_):
        raise AssertionError

    with pytest.raises(ValueError, match="extension"):
        analysis.analyse(spark.range(1), {"quietDay": never}, [analysis.Extension(n, never) for n in names])


def test_extension_without_profiles(spark):
    hours = spark.range(3).withColumnRenamed("id", "profile_id")
    with pytest.raises(ValueError, match="me/odd"):
        analysis.analyse(hours, {"quietDay": lambda h: h}, [analysis.Extension("me/odd", lambda h, _: h.select(F.lit(1).alias("x")))])


def test_compared_from_one_frame(spark):
    from ridgelift.plans import catalogue, contracts

    got = contracts.compared(spark, "/root/testdata/sf0.001")
    want = catalogue.queries()["c03_window_agreement"](spark, "/root/testdata/sf0.001")
    assert sorted(map(str, got["agreement"].collect())) == sorted(map(str, want.collect())) and set(got) == {"agreement", "board"}
    spark.catalog.clearCache()


@pytest.mark.parametrize(("day", "utc_days", "hours"), [("2026-03-08", ["2026-03-08", "2026-03-09"], 24), ("2026-11-01", ["2026-11-01", "2026-11-02"], 24), ("2026-07-01", ["2026-07-01", "2026-07-02"], 24)])
def test_only_the_days_needed(spark, tmp_path, day, utc_days, hours):
    start = dt.datetime.fromisoformat(day) - dt.timedelta(days=3)
    points = [(k, start + dt.timedelta(minutes=30 * k)) for k in range(48 * 7)]
    archive.append_points(spark.createDataFrame(points, "k long, observed_at timestamp"), str(tmp_path / "a"))
    midnight = dt.datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(ZONE))
    since = midnight.astimezone(dt.timezone.utc)
    until = since + dt.timedelta(hours=24)
    got = archive.read_window(spark, str(tmp_path / "a"), since, until)
    naive = since.replace(tzinfo=None)
    assert sorted(r["observed_at"] for r in got.collect()) == [t for _, t in points if naive <= t < naive + dt.timedelta(hours=24)] and got.count() == 2 * hours
    scan = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x][0]
    assert "utc_day" in scan
    read = {r[0].split("utc_day=")[1][:10] for r in got.select(F.input_file_name()).distinct().collect()}
    assert sorted(read) == utc_days
    whole_day = archive.read_window(spark, str(tmp_path / "a"), dt.datetime(2026, 3, 8), dt.datetime(2026, 3, 9))
    assert len({r[0] for r in whole_day.select(F.input_file_name()).distinct().collect() if "utc_day=2026-03-09" in r[0]}) == 0


def test_days(spark):
    df = spark.createDataFrame([("2026-03-08",), ("2026-02-30",), ("x",), ("2026-12-31",)], "d string")
    start, end = archive.day_window(F.col("d"), ZONE)
    rows = df.select("d", start, end, archive.day_step(F.col("d"), 1), *archive.trailing_window(F.lit("2026-01-01 12:00:00").cast("timestamp"), 6)).collect()
    assert rows[0][1:4] == (dt.datetime(2026, 3, 8, 8), dt.datetime(2026, 3, 9, 8), "2026-03-09") and rows[1][1:4] == (None, None, None) and rows[2][1] is None and rows[3][3] == "2027-01-01"
    assert rows[0][4] == dt.datetime(2026, 1, 1, 6)


def test_tags_and_rows_without_a_reading(spark):
    def plain(text):
        lanes = []
        units = text.encode("utf-16-be")
        for h in (0x811C9DC5, 0x01234567):
            for i in range(0, len(units), 2):
                h = (h ^ int.from_bytes(units[i : i + 2], "big")) * 0x01000193 & 0xFFFFFFFF
            lanes.append(f"{h:08x}")
        return f'W/"{"".join(lanes)}"'

    texts = ["", '{"a":1}', "λ💩é", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tags = {r[0]: r[1] for r in df.select("t", wire.weak_tag(F.col("t"))).collect()}
    assert tags == {t: plain(t) for t in texts}
    tag = tags[""]
    asked = {None: False, "*": True, tag: True, tag[2:]: True, f'"x", {tag}': True, '"x"': False, "": False}
    rows = spark.createDataFrame([(a,) for a in asked], "a string").select("a", wire.tag_matches(F.col("a"), F.lit(tag))).collect()
    assert {r[0]: r[1] for r in rows} == asked
    row = spark.range(1).select(wire.no_conditions(uv_index=F.lit(3)).alias("c"), wire.unavailable(F.struct(F.lit("s").alias("id")), F.lit("timeout"), "struct<wind:double>").alias("u")).head()
    assert row["c"]["uv_index"] == 3.0 and sum(v is not None for v in row["c"]) == 1 and (row["u"]["meta"]["id"], row["u"]["status"], row["u"]["reason"], row["u"]["reading"]) == ("s", "unavailable", "timeout", None)
    with pytest.raises(ValueError, match="no such conditions"):
        wire.no_conditions(humour=F.lit(1))


def test_names_of_other_kinds(spark):
    good = "rrfs.20260701/12/rrfs.t12z.prslev.3km.f006.conus.grib2"
    names = [good, good.replace("t12z", "t18z"), good.replace("20260701", "20260732"), good + ".idx", "x" + good, "hrrr.20260701/conus/hrrr.t12z.wrfprsf06.grib2", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", file_names.read_name("rrfs", F.col("n")).alias("r")).orderBy("i").collect()
    assert tuple(rows[0]["r"]) == (dt.datetime(2026, 7, 1, 12), 6, "prslev") and all(r["r"] is None for r in rows[1:])
    at = F.lit("2026-07-01 00:00:00").cast("timestamp")
    row = spark.range(1).select(file_names.file_name("members", at, F.lit(384), variable=F.lit("TMP_TGL_2m")).alias("m"), file_names.file_name("west", at, F.lit(7), variable=F.lit("TMP")).alias("w")).head()
    assert row["m"] == "CMC_geps-raw_TMP_TGL_2m_latlon0p5x0p5_2026070100_P384_allmbrs.grib2" and row["w"] == "CMC_hrdps_west_TMP_rotated_latlon0.009x0.009_20260701T00Z_P007-00.grib2"
    with pytest.raises(ValueError, match="needs variable"):
        file_names.file_name("nam", at, F.lit(1))
