"""Weather-shaped views of the driver's tables, and the same views as SQL.

Missing stays missing: an absent measure is null, never zero, and calm air has no direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nominal minutes between two history points of a station.
PERIOD_MINUTES = 360


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, seq, observed_at, wind_avg_mps, wind_gust_mps, wind_lull_mps, wind_direction_deg, temperature_c, sea_level_pressure_hpa."""
    speed = F.col("value") / 20.0
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("station_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("observed_at"),
        speed.alias("wind_avg_mps"),
        F.when(kind != "error", speed * 1.3 + 1).alias("wind_gust_mps"),
        F.when(kind != "error", speed * 0.6).alias("wind_lull_mps"),
        F.when(speed >= 0.5, (F.col("event_id") * 37 % 360).cast("double")).alias("wind_direction_deg"),
        F.when(kind != "signup", (F.col("event_id") * 7 % 35).cast("double") - 5).alias("temperature_c"),
        F.when(kind != "view", (F.col("event_id") * 11 % 50).cast("double") + 990.0).alias("sea_level_pressure_hpa"),
    )


HISTORY = """h as (select user_id as station_id, event_id as seq, ts as observed_at, value / 20.0::double as wind_avg_mps,
 case when event_type = 'error' then null else value / 20.0::double * 1.3::double + 1 end as wind_gust_mps,
 case when event_type = 'error' then null else value / 20.0::double * 0.6::double end as wind_lull_mps,
 case when value / 20.0::double < 0.5::double then null else ((event_id * 37) % 360)::double end as wind_direction_deg,
 case when event_type = 'signup' then null else ((event_id * 7) % 35)::double - 5 end as temperature_c,
 case when event_type = 'view' then null else ((event_id * 11) % 50)::double + 990.0::double end as sea_level_pressure_hpa
 from events)"""


def forecast_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, hour_id, valid_at, model, model_elevation_m, temperature_c, dew_point_depression_c, both heat fluxes."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("site_id"),
        k.alias("hour_id"),
        F.col("o_orderdate").alias("valid_at"),
        F.col("o_orderpriority").alias("model"),
        (200 + F.col("o_custkey") * 13 % 1200).cast("double").alias("model_elevation_m"),
        (5 + k * 3 % 25).cast("double").alias("temperature_c"),
        ((k * 5 % 150).cast("double") / 10.0).alias("dew_point_depression_c"),
        (F.col("o_totalprice") / 500.0 - 100).alias("sensible_heat_flux_wm2"),
        (k * 17 % 300).cast("double").alias("latent_heat_flux_wm2"),
    )


HOURS = """o as (select o_custkey as site_id, o_orderkey as hour_id, o_orderdate as valid_at, o_orderpriority as model,
 (200 + (o_custkey * 13) % 1200)::double as model_elevation_m, (5 + (o_orderkey * 3) % 25)::double as temperature_c,
 ((o_orderkey * 5) % 150)::double / 10.0::double as dew_point_depression_c, o_totalprice / 500.0::double - 100 as sensible_heat_flux_wm2,
 ((o_orderkey * 17) % 300)::double as latent_heat_flux_wm2 from orders)"""


def forecast_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour_id, level_index (ascending height), pressure_hpa, height_m, temperature_c, dew_point_depression_c, wind."""
    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    rn = F.col("level_index")
    h = F.col("height_m")
    return (
        table(spark, sf_dir, "lineitem")
        .select("*", F.row_number().over(by_line).alias("level_index"))
        .withColumn("height_m", (400 * rn + F.col("l_partkey") % 300).cast("double"))
        .select(
            F.col("l_orderkey").alias("hour_id"),
            "level_index",
            (1025 - 25 * rn).cast("double").alias("pressure_hpa"),
            "height_m",
            (20.0 - h * 0.0065 + F.col("l_discount") * 30).alias("temperature_c"),
            (F.col("l_tax") * 100).alias("dew_point_depression_c"),
            (F.col("l_quantity") / 2.0).alias("wind_speed_mps"),
            (F.col("l_suppkey") * 29 % 360).cast("double").alias("wind_direction_deg"),
        )
    )


LEVELS = """l as (select hour_id, level_index, (1025 - 25 * level_index)::double as pressure_hpa, h as height_m,
 20.0::double - h * 0.0065::double + l_discount * 30 as temperature_c, l_tax * 100 as dew_point_depression_c,
 l_quantity / 2.0::double as wind_speed_mps, ((l_suppkey * 29) % 360)::double as wind_direction_deg
 from (select l_orderkey as hour_id, rn as level_index, (400 * rn + l_partkey % 300)::double as h, l_discount, l_tax, l_quantity, l_suppkey
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as rn from lineitem) a) b)"""


def member_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour_id, member, v: the elements of a vector stand for an ensemble's members. Every tenth value is missing."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hour_id"), F.posexplode("embedding").alias("member", "x"))
    return rows.select("hour_id", "member", F.when((F.col("hour_id") + F.col("member")) % 10 != 0, F.col("x").cast("double") * 100).alias("v"))


MEMBERS = """m as (select hour_id, member, case when (hour_id + member) % 10 <> 0 then x::double * 100 end as v from
 (select vec_id as hour_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as member from embeddings) e)"""
