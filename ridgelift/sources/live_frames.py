"""A station vendor's live events as typed frames: init, samples, reading, summaries, ping. What breaks the contract is a frame too: `broken`, with its problem.

An event is one row: station_id, seq (its place in the stream), event (its name), data (JSON), and what the station is configured to have. Events of other names
and messages of unknown types give no frame; a digest gives a reading and, if it carries step blocks, summaries (part 1 of the same seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import air, wind
from ridgelift.functions.times import offset_minutes
from ridgelift.functions.wind import PLAUSIBLE_MPS

# Fixed values of the vendor's contract.
PRESSURE_HPA, BATTERY_V = (300.0, 1100.0), (0.0, 100.0)
STEPS = (("last_10mn_by_1mn", 1, 10), ("last_60mn_by_5mn", 5, 60))
READING = "observed_at timestamp, wind_avg_mps double, wind_direction_deg double, wind_gust_mps double, wind_lull_mps double, temperature_c double, sea_level_pressure_hpa double, battery_v double"
SAMPLES = "array<struct<observed_at:timestamp,wind_mps:double,wind_direction_deg:double>>"
POINTS = "array<struct<observed_at:timestamp,wind_avg_mps:double,wind_gust_mps:double,wind_lull_mps:double,wind_direction_deg:double,wind_vector_avg_mps:double>>"
SUMMARIES = f"array<struct<window_minutes:int,step_minutes:int,points:{POINTS}>>"
PLACE = "latitude double, longitude double, altitude_m double, time_zone string, standard_offset_minutes int, favourable array<struct<from_deg:double,to_deg:double>>, delay_s double"


def _schema(x: str) -> str:
    """Of a message, with numbers read as x: as doubles to use them, as strings to tell what is missing from what is no number."""
    step = f"struct<wind_avg_1D:{x},wind_avg_2D:{x},wind_dir:{x},wind_max:{x},wind_min:{x}>"
    recent = f"struct<date_utc:string,wind_avg_1D:{x},wind_avg_2D:{x},wind_dir:{x},wind_max:{x},wind_min:{x},temperature:{x},pressure_hpa:{x},voltage:{x}>"
    digest = f"recent:{recent},last_10mn_by_1mn:array<{step}>,last_60mn_by_5mn:array<{step}>"
    arcs = f"array<struct<from:{x},to:{x}>>"
    location = f"struct<guessed_position:struct<lat:{x},lon:{x}>,altitude:{x},timezone:string,standard_timeoffset:string,location_type_meta:struct<dir_ranges:{arcs}>>"
    return f"struct<type:string,delay:{x},digest:struct<{digest}>,{digest},samples:array<struct<ts:string,sp:{x},dir:{x}>>,location:{location}>"


def _within(x: Column, low: float, high: float) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _refused(number: Column, said: Column, low: float, high: float) -> Column:
    """Something was said that is no number in its range."""
    return said.isNotNull() & ~_yes(_within(number, low, high))


def _direction(speed: Column, deg: Column) -> Column:
    return F.when(~wind.is_calm(speed), wind.normalize(deg))


def _digest(message: str) -> Column:
    """The digest of an init message, or the message itself."""
    names = ("recent", "last_10mn_by_1mn", "last_60mn_by_5mn")
    return F.when(F.col("m.type") == "INIT", F.col(f"{message}.digest")).otherwise(F.struct(*[F.col(f"{message}.{n}").alias(n) for n in names]))


def _points(entries: Column, said: Column, anchor: Column, minutes: int) -> Column:
    """Points of a block of steps, the last at the anchor; an empty step is absent, a malformed one makes the block null."""
    size = F.size(entries)

    def point(pair: Column, i: Column) -> Column:
        e = pair["e"]
        ranged = lambda f, high: F.when(_within(e[f], 0.0, high), e[f])
        speed = F.coalesce(ranged("wind_avg_1D", PLAUSIBLE_MPS), ranged("wind_avg_2D", PLAUSIBLE_MPS))
        deg = ranged("wind_dir", 360.0)
        at = F.timestamp_micros(F.unix_micros(anchor) - (size - 1 - i) * F.lit(minutes * 60_000_000))
        row = F.struct(at.alias("observed_at"), speed.alias("wind_avg_mps"), ranged("wind_max", PLAUSIBLE_MPS).alias("wind_gust_mps"), ranged("wind_min", PLAUSIBLE_MPS).alias("wind_lull_mps"), _direction(speed, deg).alias("wind_direction_deg"), ranged("wind_avg_2D", PLAUSIBLE_MPS).alias("wind_vector_avg_mps"))
        return F.struct(pair["s"].isNull().alias("empty"), (speed.isNotNull() & deg.isNotNull()).alias("whole"), row.alias("p"))

    made = F.transform(F.arrays_zip(entries.alias("e"), said.alias("s")), point)
    whole = F.forall(made, lambda x: x["empty"] | x["whole"])
    return F.when(_yes(whole), F.transform(F.filter(made, lambda x: ~x["empty"]), lambda x: x["p"]))


def frames(events: DataFrame) -> DataFrame:
    """events: station_id, seq, event, data, served_at, has_temperature, has_pressure, has_battery, elevation_m (batch or stream).

    Returns station_id, seq, part, kind, served_at, reading, samples, summaries, place (of an init), problem.
    """
    e = events.where(F.col("event").isin("message", "ping")).withColumn("ping", F.col("event") == "ping")
    e = e.withColumn("m", F.from_json("data", _schema("double"))).withColumn("s", F.from_json("data", _schema("string")))
    readable = F.get_json_object("data", "$").startswith("{")
    e = e.withColumn("type", F.when(F.col("ping"), "ping").when(~_yes(readable), "unreadable").otherwise(F.col("m.type")))
    e = e.withColumn("d", _digest("m")).withColumn("ds", _digest("s"))

    last = F.try_element_at("d.last_10mn_by_1mn", F.lit(-1))
    last_said = F.try_element_at("ds.last_10mn_by_1mn", F.lit(-1))
    own = last_said.isNotNull()  # the newest whole minute, or else the recent block
    w = lambda f: F.when(own, last[f]).otherwise(F.col(f"d.recent.{f}"))
    ws = lambda f: F.when(own, last_said[f]).otherwise(F.col(f"ds.recent.{f}"))
    speed = F.coalesce(w("wind_avg_1D"), w("wind_avg_2D"))
    at = F.try_to_timestamp(F.col("d.recent.date_utc"))
    inf = float("inf")
    problem = F.when(F.col("ds.recent").isNull(), "digest").when(at.isNull(), "digest time")
    for f, high in (("wind_avg_1D", PLAUSIBLE_MPS), ("wind_avg_2D", PLAUSIBLE_MPS), ("wind_dir", 360.0), ("wind_max", PLAUSIBLE_MPS), ("wind_min", PLAUSIBLE_MPS)):
        problem = problem.when(_refused(w(f), ws(f), 0.0, high), f)
    problem = problem.when(speed.isNull(), "wind average").when(w("wind_dir").isNull(), "wind_dir")
    for f, (low, high) in (("temperature", (-inf, inf)), ("pressure_hpa", PRESSURE_HPA), ("voltage", BATTERY_V)):
        problem = problem.when(_refused(F.col(f"d.recent.{f}"), F.col(f"ds.recent.{f}"), low, high), f)
    has = lambda flag, value: F.when(F.col(flag), value)
    t, p = F.col("d.recent.temperature"), F.col("d.recent.pressure_hpa")
    reading = F.struct(
        at.alias("observed_at"),
        speed.alias("wind_avg_mps"),
        _direction(speed, w("wind_dir")).alias("wind_direction_deg"),
        w("wind_max").alias("wind_gust_mps"),
        w("wind_min").alias("wind_lull_mps"),
        has("has_temperature", t).alias("temperature_c"),
        has("has_pressure", air.sea_level_pressure(p, F.col("elevation_m"), t)).alias("sea_level_pressure_hpa"),
        has("has_battery", F.col("d.recent.voltage")).alias("battery_v"),
    )

    records = F.filter(F.arrays_zip(F.col("m.samples").alias("r"), F.col("s.samples").alias("s")), lambda x: x["s"].isNotNull())  # empty slots of the ring
    fine = F.forall(records, lambda x: F.try_to_timestamp(x["r"]["ts"]).isNotNull() & _within(x["r"]["sp"], 0.0, PLAUSIBLE_MPS) & _within(x["r"]["dir"], 0.0, 360.0))
    samples = F.array_sort(F.transform(records, lambda x: F.struct(F.try_to_timestamp(x["r"]["ts"]).alias("observed_at"), x["r"]["sp"].alias("wind_mps"), _direction(x["r"]["sp"], x["r"]["dir"]).alias("wind_direction_deg"))))
    sampled = F.when(F.col("s.samples").isNull(), "samples").when(~_yes(fine), "sample")

    blocks = F.array(*[F.struct(F.lit(window).alias("window_minutes"), F.lit(step).alias("step_minutes"), _points(F.col(f"d.{name}"), F.col(f"ds.{name}"), at, step).alias("points")) for name, step, window in STEPS])
    blocks = F.filter(blocks, lambda b: b["points"].isNotNull())
    summaries = F.when(at.isNotNull() & (F.size(blocks) > 0), blocks)

    arcs = F.col("m.location.location_type_meta.dir_ranges")
    number = lambda c: F.when(_within(F.col(c), -1e308, 1e308), F.col(c))
    place = F.struct(
        number("m.location.guessed_position.lat").alias("latitude"),
        number("m.location.guessed_position.lon").alias("longitude"),
        number("m.location.altitude").alias("altitude_m"),
        F.nullif(F.col("m.location.timezone"), F.lit("")).alias("time_zone"),
        offset_minutes(F.trim("m.location.standard_timeoffset")).cast("int").alias("standard_offset_minutes"),
        F.when(_yes(F.forall(arcs, lambda a: a["from"].isNotNull() & a["to"].isNotNull())), F.transform(arcs, lambda a: F.struct(a["from"].alias("from_deg"), a["to"].alias("to_deg")))).alias("favourable"),
        F.when(_within(F.col("m.delay"), 0.0, 1e308), F.col("m.delay")).alias("delay_s"),
    )

    init, digest = F.col("type") == "INIT", F.col("type").isin("INIT", "LAST_DIGEST")
    wrong = F.when(F.col("type") == "unreadable", "unreadable").when(digest, F.coalesce(problem, F.when(init, sampled))).when(F.col("type") == "WIND_SAMPLES", sampled)
    e = e.withColumn("problem", wrong).withColumn("reading", reading.cast(f"struct<{READING.replace(' ', ':').replace(',:', ',')}>")).withColumn("samples", samples.cast(SAMPLES)).withColumn("summaries", summaries.cast(SUMMARIES)).withColumn("place", place)
    kind = F.when(F.col("problem").isNotNull(), "broken").when(init, "init").when(F.col("type") == "WIND_SAMPLES", "samples").when(F.col("type") == "LAST_DIGEST", "reading").otherwise("ping")
    two = (kind == "reading") & F.col("summaries").isNotNull()
    framed = F.col("type").isin("ping", "unreadable", "INIT", "WIND_SAMPLES", "LAST_DIGEST")  # told with the frames: a filter of its own would be pushed down and read every message once more
    e = e.withColumn("k", F.explode(F.when(framed, F.when(two, F.array(F.struct(F.lit(0).alias("part"), F.lit("reading").alias("kind")), F.struct(F.lit(1).alias("part"), F.lit("summaries").alias("kind")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), kind.alias("kind")))))))
    only = lambda kinds, c: F.when(F.col("k.kind").isin(*kinds), F.col(c)).alias(c)
    return e.select("station_id", "seq", "k.part", "k.kind", "served_at", only(("init", "reading"), "reading"), only(("init", "samples"), "samples"), only(("init", "summaries"), "summaries"), only(("init",), "place"), "problem")
