"""Site context around places on a raster, and the ground of models held against their pressure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.operators import terrain
from ridgelift.sources.projections import table

from .more import CELLS, RAD, cells
from .registry import Registry

R = Registry()
NAMES = {1: "trees", 2: "shrubs", 3: "grass", 4: "crops", 5: "rock"}
RELIEF, COVER = (6_000.0, 12_000.0), (12_000.0,)


def places(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("site_id"), (49.98 - (k * 11 % 37) / 100.0).alias("latitude"), (-124.9 + (k * 7 % 37) / 10.0).alias("longitude"))


PLACES = "pl as (select s_suppkey as site_id, 49.98 - (s_suppkey * 11 % 37) / 100.0::double as latitude, -124.9 + (s_suppkey * 7 % 37) / 10.0::double as longitude from supplier)"
IN_DISC = "pow((-125.0 + col * 0.1::double - longitude) * 111320.0 * cos(latitude * {rad}), 2) + pow((50.0 - row * 0.1::double - latitude) * 111132.0, 2) <= pow({m}, 2)"


@R.add(
    "m39_r19_site_context",
    f"""with {CELLS}, cc as (select row, col, z, (row * 40 + col) % 6 as code from ce), {PLACES}, f as (select *, (latitude - 50.0) / -0.1::double as fy, (longitude + 125.0) / 0.1::double as fx from pl), o as (select *, floor(fy + 0.5) as r, floor(fx + 0.5) as c, floor(fy) as y0, floor(fx) as x0 from f),
g as (select site_id, any_value(latitude) as latitude, any_value(longitude) as longitude, any_value(fy) as fy, any_value(fx) as fx, count(z) filter (abs(row - r) <= 1 and abs(col - c) <= 1) as n9, max(code) filter (row = r and col = c) as code,
 max(z) filter (row = y0 and col = x0) as q00, max(z) filter (row = y0 and col = x0 + (fx <> x0)::int) as q01, max(z) filter (row = y0 + (fy <> y0)::int and col = x0) as q10, max(z) filter (row = y0 + (fy <> y0)::int and col = x0 + (fx <> x0)::int) as q11, any_value(fx - x0) as tx, any_value(fy - y0) as ty,
 sum(case when row = r - 1 then case col - c when -1 then -z when 1 then z end when row = r then case col - c when -1 then -2 * z when 1 then 2 * z end when row = r + 1 then case col - c when -1 then -z when 1 then z end end) filter (abs(col - c) = 1) as east,
 sum(case row - r when -1 then z when 1 then -z end * case col - c when 0 then 2 else 1 end) filter (abs(row - r) = 1 and abs(col - c) <= 1) as north
 from o left join cc on row between r - 2 and r + 2 and col between c - 2 and c + 2 group by site_id),
s as (select *, q00 * (1 - tx) * (1 - ty) + q01 * tx * (1 - ty) + q10 * (1 - tx) * ty + q11 * tx * ty as surface, 12000.0 / (0.1 * 111132.0) as ry, 12000.0 / (0.1 * 111320.0 * cos(latitude * {RAD})) as rx from g),
p as (select *, case when surface is null then 'no height' when n9 < 9 then 'no slope' when coalesce(code, 0) = 0 then 'no land cover' when fy - ry < 0 or fy + ry > (select max(row) from ce) or fx - rx < 0 or fx + rx > 39 then 'disc crosses the edge' end as problem from s),
w as (select site_id, min(z) filter (a) as low6, max(z) filter (a) as high6, 100.0 * (count(*) filter (a and z < surface) + 0.5 * count(*) filter (a and z = surface)) / count(z) filter (a)::double as pct6, min(z) as low12, max(z) as high12, 100.0 * (count(*) filter (z < surface) + 0.5 * count(*) filter (z = surface)) / count(z)::double as pct12, count(*) filter (code <> 0) as n, count(*) filter (code = 3)::double / nullif(count(*) filter (code <> 0), 0) as grass
 from (select p.*, row, col, z, cc.code as code_1, {IN_DISC.format(m='6000.0', rad=RAD)} as a from p join cc on {IN_DISC.format(m='12000.0', rad=RAD)} where problem is null) t(site_id, latitude, longitude, fy, fx, n9, own, q00, q01, q10, q11, tx, ty, east, north, surface, ry, rx, problem, row, col, z, code, a) group by site_id),
v as (select p.*, low6, high6, pct6, low12, high12, pct12, grass, case when site_id % 3 = 0 then null when site_id % 3 = 1 then 'survey' else 'map' end as source, case when site_id % 3 = 1 then surface * 0 + 900 + site_id % 50 when site_id % 3 = 2 then 950 + site_id % 40 end as picked from p left join w using (site_id))
select site_id, problem, case when problem is null then coalesce(source, 'surface') end as source, case when problem is null then round(coalesce(picked, surface), 5) end as elevation_m, case when problem is null then abs(coalesce(picked, surface) - surface) > 100 end as disagrees, case when problem is null then round(surface, 5) end as surface_m,
 case when problem is null then round(atan(sqrt(pow(east / (8 * 0.1 * 111320.0 * cos(latitude * {RAD})), 2) + pow(north / (8 * 0.1 * 111132.0), 2))) / ({RAD}), 5) end as slope_deg, low6 as min_6km, high6 as max_6km, round(pct6, 6) as below_6km, low12 as min_12km, high12 as max_12km, round(pct12, 6) as below_12km,
 case when problem is null then (['trees','shrubs','grass','crops','rock'])[code] end as at_launch, case when problem is null and grass > 0 then round(grass, 6) end as grass_12km from v""",
)
def m39_r19_site_context(spark, d):
    ground = cells(spark, d).withColumn("code", ((F.col("row") * 40 + F.col("col")) % 6).cast("int"))
    raster = terrain.Raster(50.0, -0.1, -125.0, 0.1, ground.agg(F.max("row")).head()[0] + 1, 40)
    k = F.col("site_id")
    p = places(spark, d)
    surveys = p.where("site_id % 3 = 1").select(k.alias("place_id"), F.lit("survey").alias("source"), F.lit(2019).alias("year"), (900.0 + k % 50).alias("elevation_m"))
    surveys = surveys.unionByName(surveys.withColumn("year", F.lit(2010)).withColumn("elevation_m", F.lit(1.0))).unionByName(p.where("site_id % 3 > 0").select(k.alias("place_id"), F.lit("map").alias("source"), F.lit(None).cast("int").alias("year"), (950.0 + k % 40).alias("elevation_m")))
    c = terrain.site_context(p, ground, raster, surveys, NAMES, RELIEF, COVER)
    disc = lambda i, f: F.get("terrain.relief", F.lit(i))[f]
    return c.select(
        "site_id", "problem", "elevation.source", F.round("elevation.elevation_m", 5).alias("elevation_m"), "elevation.disagrees", F.round("terrain.surface_m", 5).alias("surface_m"), F.round("terrain.slope_deg", 5).alias("slope_deg"),
        *[x for i, km in ((0, 6), (1, 12)) for x in (disc(i, "min_m").alias(f"min_{km}km"), disc(i, "max_m").alias(f"max_{km}km"), F.round(disc(i, "below_pct"), 6).alias(f"below_{km}km"))],
        "land_cover.at_launch", F.round(F.try_element_at(F.get("land_cover.fractions", F.lit(0))["by_class"], F.lit(3)), 6).alias("grass_12km"),
    )


@R.add(
    "m42_implausible_ground",
    "with g as (select o_orderkey as hour_id, (o_custkey * 13 % 12000)::double as z, 1013.25 * exp(-(o_custkey * 13 % 12000) / 8434.0::double) + (o_orderkey % 7) * 15 as p from orders) select hour_id, case when abs(8434.0::double * ln(1013.25::double / p) - z) > 1000 then 'against its pressure' when z > 9000 then 'above all ground' end as problem from g",
)
def m42_implausible_ground(spark, d):
    z = (F.col("o_custkey") * 13 % 12000).cast("double")
    p = F.exp(-z / 8434.0) * 1013.25 + F.col("o_orderkey") % 7 * 15
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("hour_id"), terrain.implausible_ground(z, p).alias("problem"))
