"""Station vendors' payloads as history rows. Malformed payloads are rows too: `problem` says what is wrong, the measures are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions.air import sea_level_pressure
from ridgelift.functions.numbers import finite
from ridgelift.functions.times import naive_instant
from ridgelift.functions.wind import CALM_MPS, PLAUSIBLE_MPS


def _plausible(speed: Column) -> Column:
    return speed.isNull() | ((speed >= 0) & (speed <= PLAUSIBLE_MPS))


def columnar_records(raw: DataFrame) -> DataFrame:
    """raw: station_id, body with parallel arrays t (epoch seconds), avg, gust, lull, dir, temp. One row a point; unequal lengths or implausible wind are a problem."""
    schema = "t array<bigint>, avg array<double>, gust array<double>, lull array<double>, dir array<double>, temp array<double>"
    p = raw.select("station_id", F.from_json("body", schema).alias("p"))
    names = ("avg", "gust", "lull", "dir", "temp")
    uneven = F.lit(False)
    for c in names:
        uneven = uneven | (F.size(f"p.{c}") != F.size("p.t"))
    p = p.withColumn("problem", F.when(F.col("p").isNull() | F.col("p.t").isNull(), "unreadable").when(uneven, "uneven columns"))
    points = F.when(F.col("problem").isNull(), F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in ("t", *names)]))
    x = p.select("station_id", "problem", F.explode_outer(points).alias("r"))
    bad = ~(_plausible(F.col("r.avg")) & _plausible(F.col("r.gust")) & _plausible(F.col("r.lull")))
    ok = lambda c: F.when(~bad, F.col(f"r.{c}"))
    return x.select("station_id", F.timestamp_seconds("r.t").alias("observed_at"), ok("avg").alias("wind_avg_mps"), ok("gust").alias("wind_gust_mps"), ok("lull").alias("wind_lull_mps"), F.when(F.col("r.avg") >= CALM_MPS, ok("dir")).alias("wind_direction_deg"), ok("temp").alias("temperature_c"), F.coalesce("problem", F.when(bad, "implausible wind")).alias("problem"))


#: Codes of a refusal that asks to try again later; any other code is an error of the service.
TRY_LATER = (-1, 45001)
_LEAF = "map<string,struct<time:string,value:string>>"


def text_leaves(raw: DataFrame) -> DataFrame:
    """raw: station_id, body: {code, msg, data: {section: {name: {time, value}}}} in SI units, numbers as strings; elevation_m, if it has one.

    A section that is absent or empty leaves its measures null. The piezo rain section counts before the bucket's. `problem` is a reason code: a
    refusal is rate_limited or upstream_error, no wind section means that the device has not reported (upstream_error), and a leaf that is
    no number or out of its range breaks the contract. A row with a problem has no measures.
    """
    section = lambda name: F.from_json(F.get_json_object("body", f"$.data.{name}"), _LEAF)
    names = ("wind", "outdoor", "pressure", "solar_and_uvi", "rainfall_piezo", "rainfall", "battery")
    code = F.get_json_object("body", "$.code").try_cast("int")
    p = raw.withColumn("_code", code).withColumn("_msg", F.get_json_object("body", "$.msg")).withColumns({f"_{n}": section(n) for n in names})
    p = p.withColumns({f"_{n}": F.when(F.size(f"_{n}") > 0, F.col(f"_{n}")) for n in names}).withColumn("_rain", F.coalesce("_rainfall_piezo", "_rainfall"))
    leaf = lambda group, name, part="value": F.col(f"_{group}")[name][part].try_cast("double")
    found: dict[str, Column] = {}
    bad = F.lit(False)
    # Sections, leaves and ranges of the payload.
    for out, group, name, low, high, needed in (
        ("wind_avg_mps", "wind", "wind_speed", 0.0, PLAUSIBLE_MPS, True),
        ("wind_direction_deg", "wind", "wind_direction", 0.0, 360.0, True),
        ("wind_gust_mps", "wind", "wind_gust", 0.0, PLAUSIBLE_MPS, False),
        ("temperature_c", "outdoor", "temperature", None, None, False),
        ("dew_point_c", "outdoor", "dew_point", None, None, False),
        ("relative_humidity_pct", "outdoor", "humidity", 0.0, 100.0, False),
        ("station_pressure_hpa", "pressure", "absolute", 5e-324, None, False),
        ("precipitation_rate_mm_hr", "rain", "rain_rate", 0.0, None, False),
        ("precipitation_today_mm", "rain", "daily", 0.0, None, False),
        ("solar_radiation_wm2", "solar_and_uvi", "solar", 0.0, None, False),
        ("uv_index", "solar_and_uvi", "uvi", 0.0, None, False),
        ("battery_v", "battery", "haptic_array_battery", 5e-324, None, False),
    ):
        x = leaf(group, name)
        ok = finite(x) & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)
        present = F.lit(True) if needed else F.col(f"_{group}").isNotNull() & F.col(f"_{group}")[name].isNotNull()
        bad = bad | (present & ~F.coalesce(ok, F.lit(False)))
        found[out] = x
    at = leaf("wind", "wind_speed", "time")
    bad = bad | ~F.coalesce(finite(at) & (at >= 0), F.lit(False))
    reason = F.when(F.col("_code").isNull(), "contract_break").when(F.col("_code").isin(*TRY_LATER), "rate_limited").when(F.col("_code") != 0, "upstream_error").when(F.col("_wind").isNull(), "upstream_error").when(bad, "contract_break")
    p = p.withColumn("problem", reason).withColumns({f"_out_{k}": v for k, v in found.items()}).withColumn("_at", at)
    ok = lambda c: F.when(F.col("problem").isNull(), c)
    calm = F.col("_out_wind_avg_mps") < CALM_MPS
    measures = {k: ok(F.col(f"_out_{k}")) for k in found} | {"wind_direction_deg": ok(F.when(~calm, F.pmod(F.col("_out_wind_direction_deg"), F.lit(360.0))))}
    if "elevation_m" in raw.columns:
        measures["sea_level_pressure_hpa"] = ok(sea_level_pressure(F.col("_out_station_pressure_hpa"), F.col("elevation_m"), F.col("_out_temperature_c")))
    return p.select("station_id", ok(F.timestamp_seconds("_at")).alias("observed_at"), *[v.alias(k) for k, v in measures.items()], "problem", F.when(F.col("_code") != 0, F.concat_ws(" ", F.col("_msg"), F.format_string("(code %d)", "_code"))).alias("message"))


def service_state(state: Column) -> Column:
    """A modem's state by the beginning of its name; unknown without one. States before activation are inactive."""
    s = state
    return F.when(s.startswith("LIVE"), "active").when(s.startswith("PAUSED"), "paused").when(s.startswith("DEAD"), "retired").when(s.startswith("INACTIVE") | s.startswith("FACTORY") | s.startswith("TEST"), "inactive").otherwise("unknown")


def single_observation(raw: DataFrame) -> DataFrame:
    """raw: station_id, expected_id, body: {station_id, latitude, longitude, elevation, obs: [{...}]}, numbers as numbers. The first observation, or a problem: contract_break.

    The rate of rain is a minute's fall, so an hour has sixty of it. Calm air has no direction.
    """
    get = lambda path: F.get_json_object("body", path)
    num = lambda name: get(f"$.obs[0].{name}").try_cast("double")
    there = lambda name: get(f"$.obs[0].{name}").isNotNull()
    # Fields of the payload, their ranges, whether they must be there.
    fields = (
        ("wind_avg_mps", "wind_avg", 0.0, PLAUSIBLE_MPS, True),
        ("wind_direction_deg", "wind_direction", 0.0, 360.0, True),
        ("wind_gust_mps", "wind_gust", 0.0, PLAUSIBLE_MPS, True),
        ("wind_lull_mps", "wind_lull", 0.0, PLAUSIBLE_MPS, False),
        ("temperature_c", "air_temperature", None, None, True),
        ("wind_chill_c", "wind_chill", None, None, False),
        ("dew_point_c", "dew_point", None, None, False),
        ("relative_humidity_pct", "relative_humidity", 0.0, 100.0, False),
        ("sea_level_pressure_hpa", "sea_level_pressure", 5e-324, None, False),
        ("precipitation_rate_mm_hr", "precip", 0.0, None, False),
        ("precipitation_today_mm", "precip_accum_local_day", 0.0, None, False),
        ("solar_radiation_wm2", "solar_radiation", 0.0, None, False),
        ("uv_index", "uv", 0.0, None, False),
        ("lightning_last_hour", "lightning_strike_count_last_1hr", 0.0, None, False),
    )
    bad = ~F.coalesce(get("$.station_id").try_cast("bigint") == F.col("expected_id"), F.lit(False)) | ~F.coalesce(finite(num("timestamp")), F.lit(False))
    for _, name, low, high, needed in fields:
        x = num(name)
        ok = finite(x) & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)
        bad = bad | ((F.lit(True) if needed else there(name)) & ~F.coalesce(ok, F.lit(False)))
    p = raw.withColumn("problem", F.when(bad, "contract_break"))
    kept = lambda c: F.when(F.col("problem").isNull(), c)
    out = {o: kept(num(n)) for o, n, *_ in fields}
    out["precipitation_rate_mm_hr"] = out["precipitation_rate_mm_hr"] * 60
    out["wind_direction_deg"] = F.when(out["wind_avg_mps"] >= CALM_MPS, F.pmod(out["wind_direction_deg"], F.lit(360.0)))
    place = [kept(get(f"$.{n}").try_cast("double")).alias(o) for o, n in (("latitude", "latitude"), ("longitude", "longitude"), ("elevation_m", "elevation"))]
    return p.select("station_id", kept(F.timestamp_seconds(num("timestamp"))).alias("observed_at"), *[c.alias(k) for k, c in out.items()], *place, "problem")


# The fields that a logger's history table must have, with their process and units.
HISTORY_FIELDS = (("Temp", "Smp", "Deg C"), ("WindDir", "Smp", "degrees"), ("WS_kph_Max", "Max", "kilometers/hour"), ("WS_kph_Avg", "Avg", "kilometers/hour"), ("WS_kph_Min", "Min", "kilometers/hour"))


def logger_table(raw: DataFrame, zone: str, fields: tuple[tuple[str, str, str], ...] = HISTORY_FIELDS) -> DataFrame:
    """raw: station_id, table_name, body: {more, head: {environment, fields: [{name, process, type, units}]}, data: [{time, vals}]}. One row a record, in place order, or a row with a problem.

    The table must be whole, named as expected, its fields as in `fields` (of floats), and each record as long as the fields. Times are wall clock times of the zone: of the two instants of an
    hour that comes twice a record takes the first that is later than its predecessor's. Speeds come in km/h.
    """
    schema = "more boolean, head struct<environment:struct<table_name:string>,fields:array<struct<name:string,process:string,type:string,units:string>>>, data array<struct<time:string,vals:array<string>>>"
    p = raw.withColumn("t", F.from_json("body", schema))
    told = F.transform("t.head.fields", lambda f: F.concat_ws("|", f["name"], f["process"], f["units"], f["type"]))
    has = F.size(F.array_except(F.array(*[F.lit("|".join((*f, "xsd:float"))) for f in fields]), told)) == 0
    shape = F.forall("t.data", lambda r: r["time"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$") & (F.size(r["vals"]) == F.size("t.head.fields")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    problem = F.when(~yes(F.col("t.more") == False), "incomplete").when(~yes(F.col("t.head.environment.table_name") == F.col("table_name")), "wrong table").when(~yes(has), "fields changed").when(~yes(shape), "records")  # noqa: E712
    p = p.withColumn("problem", problem)
    start = F.array().cast("array<bigint>")
    instants = F.aggregate(F.transform("t.data", lambda r: r["time"]), start, lambda s, x: F.array_append(s, naive_instant(x, zone, after_s=F.try_element_at(s, F.lit(-1)))))
    records = F.arrays_zip(F.col("t.data").alias("data"), instants.alias("at_s"))
    x = p.select("station_id", "problem", "t.head.fields", F.posexplode_outer(F.when(F.col("problem").isNull(), records)).alias("place", "r"))

    def value(name: str) -> Column:
        at = F.array_position(F.transform("fields", lambda f: f["name"]), name)
        return F.get(F.col("r.data.vals"), (at - 1).cast("int")).try_cast("double")

    mps = {c: value(n) / 3.6 for c, n in (("wind_avg_mps", "WS_kph_Avg"), ("wind_gust_mps", "WS_kph_Max"), ("wind_lull_mps", "WS_kph_Min"))}
    way = F.when(mps["wind_avg_mps"] >= CALM_MPS, F.pmod(value("WindDir"), F.lit(360.0)))
    return x.select("station_id", "place", F.timestamp_seconds("r.at_s").alias("observed_at"), *[c.alias(k) for k, c in mps.items()], way.alias("wind_direction_deg"), value("Temp").alias("temperature_c"), "problem")


def enriched(config: DataFrame, vendor: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """config with each station's fields filled from the vendor's where it has none of its own."""
    v = vendor.select("station_id", *[F.col(f).alias(f"_{f}") for f in fields])
    return config.join(v, "station_id", "left").withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def real_time(text: Column) -> Column:
    """An instant, unless it is the sentinel of year zero or empty."""
    return F.when(~text.startswith("0000-00-00") & (F.trim(text) != ""), F.try_to_timestamp(text))


def failure_reason(kind: Column, carried: Column) -> Column:
    """A reason code: kind is the class of the error, carried the reason that an UpstreamError was raised with. What is of no known class broke the contract."""
    return F.when(kind == "UpstreamError", F.coalesce(carried, F.lit("upstream_error"))).when(kind.isin("TimeoutError", "AbortError"), "timeout").when(kind == "TypeError", "upstream_error").otherwise("contract_break")


def overlay(feed: DataFrame, current: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """feed with each station's newer reading; measures the reading omits stay as they were."""
    c = current.select("station_id", *[F.col(k).alias(f"_{k}") for k in keep])
    return feed.join(c, "station_id", "left").withColumns({k: F.coalesce(f"_{k}", k) for k in keep}).drop(*[f"_{k}" for k in keep])
