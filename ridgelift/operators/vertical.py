"""What a vertical section shows of an hour: values at heights, from the ground through its levels. Everything is a fold or a transform of the hour's own array, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import air, wind

FIELDS = ("height_m", "temperature_c", "dew_point_depression_c", "wind_speed_mps", "wind_direction_deg")


def nodes(h: DataFrame) -> DataFrame:
    """hour_id, kind, altitude_m, value of hours with levels above the ground (model_elevation_m): lapse (C per 1000 ft, of the layer above; the last level takes the layer below), depression,
    humidity, and shear (m/s per km) at the middle of each layer. h: surface measures under the levels' names, and levels, ascending and no two at one height."""
    ground = F.struct(F.col("model_elevation_m").alias("height_m"), *[F.col(f) for f in FIELDS[1:]])
    column = F.concat(F.array(ground), F.transform("levels", lambda v: F.struct(*[v[f].cast("double").alias(f) for f in FIELDS])))
    x = h.where((F.size("levels") > 0) & (F.element_at("levels", 1)["height_m"] > F.col("model_elevation_m"))).select("hour_id", column.alias("c"))
    n = F.size("c")
    x = x.withColumn("p", F.arrays_zip(F.slice("c", F.lit(1), n - 1).alias("a"), F.slice("c", F.lit(2), n - 1).alias("b")))
    node = lambda z, v: F.struct(z.alias("altitude_m"), v.alias("value"))

    def change(p: Column) -> Column:
        return air.lapse_per_km(p["a"]["temperature_c"], p["a"]["height_m"], p["b"]["temperature_c"], p["b"]["height_m"]) * (air.FEET_1000 / 1000)

    def dew(v: Column) -> Column:
        return v["temperature_c"] - v["dew_point_depression_c"]

    def rate(p: Column) -> Column:
        a, b = p["a"], p["b"]
        uv = [f(v["wind_speed_mps"], v["wind_direction_deg"]) for v in (a, b) for f in (wind.u_of, wind.v_of)]
        return wind.shear(*uv) / (b["height_m"] - a["height_m"]) * 1000

    x = x.withColumn("lapses", F.transform("p", change))
    kinds = {
        "lapse": F.transform("c", lambda v, i: node(v["height_m"], F.element_at(F.col("lapses"), F.least(i + 1, F.size("lapses"))))),
        "depression": F.transform("c", lambda v: node(v["height_m"], v["dew_point_depression_c"])),
        "humidity": F.transform("c", lambda v: node(v["height_m"], air.relative_humidity(v["temperature_c"], dew(v)))),
        "shear": F.transform(F.filter("p", lambda p: p["b"]["height_m"] > p["a"]["height_m"]), lambda p: node((p["a"]["height_m"] + p["b"]["height_m"]) / 2, rate(p))),
    }
    every = F.flatten(F.array(*[_named(a, k) for k, a in kinds.items()]))
    return x.select("hour_id", F.explode(every).alias("n")).select("hour_id", "n.*")


def _named(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v["altitude_m"].alias("altitude_m"), v["value"].alias("value")))


def wind_pairs(values: DataFrame, keys: list[str], members: int | None = None) -> DataFrame:
    """values: keys, member, component (u or v), value. One wind a member that has both; the job fails where a group has fewer than the members asked for."""
    w = values.groupBy(*keys, "member").agg(F.max(F.when(F.col("component") == "u", F.col("value"))).alias("u"), F.max(F.when(F.col("component") == "v", F.col("value"))).alias("v"))
    w = w.where("u is not null and v is not null")
    w = w.select(*keys, "member", wind.speed_of(F.col("u"), F.col("v")).alias("speed_mps"), wind.direction_of(F.col("u"), F.col("v")).alias("direction_deg"))
    if members is None:
        return w
    count = w.groupBy(*keys).agg(F.count("*").alias("_n"))
    short = F.raise_error(F.format_string("%d of %d members", F.col("_n"), F.lit(members))).cast("double")
    return w.join(count, keys).withColumn("speed_mps", F.when(F.col("_n") < members, short).otherwise(F.col("speed_mps"))).drop("_n")


def required(value: Column, name: str) -> Column:
    """The value; a job that meets a missing or non-finite one fails naming it."""
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{name} is missing")).cast("double")).otherwise(value)
