"""Words, listings, slugs, coherence of members and the order of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgelift.functions import wind
from ridgelift.operators import findings, series, texts
from ridgelift.sources.projections import HISTORY, LEVELS, forecast_level, station_history, table

from . import findings as finding_plans
from .findings import shared_hours
from .registry import Registry

R = Registry()
_C = "(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[(floor(wind_direction_deg / 22.5 + 0.5)::int % 16) + 1]"


@R.add(
    "d09_d10_words",
    f"""with {HISTORY} select seq, case when wind_gust_mps is null then '—' else floor(wind_gust_mps * 3.6::double + 0.5)::bigint::varchar end as gust_kmh, case when wind_avg_mps < 0.5 then 'calm' when wind_direction_deg is null then '—' else {_C} || ' ' || floor(wind_direction_deg + 0.5)::bigint::varchar end as direction,
 case when a < 60 then 'just now' when a < 3600 then floor(a / 60)::bigint::varchar || ' min ago' else floor(a / 3600)::bigint::varchar || ' h ago' end as age, abs(abs(a) - 3600) <= 300 as hour_skew, round(((epoch_us(observed_at) - epoch_us(timestamp '2023-12-21')) / (365.25 * 86400e6)) % 1, 9) as season
from (select *, (epoch_us(timestamp '2024-02-10 00:00:00') - epoch_us(observed_at)) / 1e6 as a from h) t""",
)
def d09_d10_words(spark, d):
    h, now = station_history(spark, d), F.lit("2024-02-10 00:00:00").cast("timestamp")
    age = F.unix_micros(now) / 1e6 - F.unix_micros(F.col("observed_at").cast("timestamp")) / 1e6
    return h.select("seq", texts.speed_text(F.col("wind_gust_mps"), wind.KMH_PER_MPS).alias("gust_kmh"), texts.direction_text(F.col("wind_avg_mps"), F.col("wind_direction_deg")).alias("direction"), texts.age_text(age).alias("age"), texts.hour_skew(F.col("observed_at"), now).alias("hour_skew"), F.round(texts.season_phase(F.col("observed_at").cast("timestamp")), 9).alias("season"))


@R.add(
    "d14_listed_keys",
    """with b as (select c_nationkey as path, c_custkey, case c_custkey % 4 when 0 then '.txt' when 1 then '&x<.nc' when 2 then '<=' || chr((33 + c_custkey % 90)::int) || chr((955 + c_custkey % 9)::int) || '.nc' else '&lt;' || chr(128169) || '.nc' end as tail from customer)
select path, 'd/' || c_custkey::varchar || tail as key from b where c_custkey % 4 <> 0""",
)
def d14_listed_keys(spark, d):
    k = F.col("c_custkey")
    numbers = F.concat(F.lit("&#60;&#x3D;&#"), (33 + k % 90).cast("string"), F.lit(";&#x0"), F.hex(955 + k % 9), F.lit(";.nc"))
    tail = F.when(k % 4 == 0, ".txt").when(k % 4 == 1, "&amp;x&lt;.nc").when(k % 4 == 2, numbers).otherwise("&amp;lt;&#128169;.nc")
    item = F.concat(F.lit("<Contents><Key>d/"), k.cast("string"), tail, F.lit("</Key><Size>1</Size></Contents>"))
    body = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("path")).agg(F.array_join(F.collect_list(item), "\n").alias("body"))
    return texts.listed_keys(body, ".nc").select("path", "key")


@R.add(
    "d22_r34_slugs",
    r"""with t as (select o_orderkey as k, case o_orderkey % 5 when 0 then 'big-hill-' || o_orderkey::varchar when 1 then 'Big Hill' when 2 then 'https://example.net/en/key-' || o_orderkey::varchar when 3 then 'https://example.net/fr/key' else '-x' end as s, case o_orderkey % 4 when 0 then null when 1 then (o_orderkey % 400 / 7.0::double)::varchar when 2 then 'x' else (o_orderkey % 90)::varchar end as h from orders)
select k, k % 5 = 0 as slug, case when k % 5 = 0 then s when k % 5 = 2 then 'key-' || k::varchar end as key, case when h is null then 48.0 when try_cast(h as double) > 0 and try_cast(h as double) <= 48 then least(48.0, greatest(0.25, floor(try_cast(h as double) / 0.25 + 0.5) * 0.25)) end as hours from t""",
)
def d22_r34_slugs(spark, d):
    k = F.col("o_orderkey")
    n = k.cast("string")
    s = F.when(k % 5 == 0, F.concat(F.lit("big-hill-"), n)).when(k % 5 == 1, "Big Hill").when(k % 5 == 2, F.concat(F.lit("https://example.net/en/key-"), n)).when(k % 5 == 3, "https://example.net/fr/key").otherwise("-x")
    h = F.when(k % 4 == 1, (k % 400 / F.lit(7.0)).cast("string")).when(k % 4 == 2, "x").when(k % 4 == 3, (k % 90).cast("string"))
    return table(spark, d, "orders").select(k.alias("k"), texts.is_slug(s).alias("slug"), texts.station_key(s, "example.net").alias("key"), texts.history_hours(h, 48.0).alias("hours"))


@R.add("r11_depressions", f"with {LEVELS}, r as (select *, greatest(1.0, least(100.0, level_index * 13.0 % 110)) as rh from l), e as (select *, ln(rh / 100) + 17.625 * temperature_c / (243.04 + temperature_c) as g from r) select hour_id, level_index, round(temperature_c - 243.04 * g / (17.625 - g), 5) as dew_point_depression_c from e")
def r11_depressions(spark, d):
    rows = forecast_level(spark, d).withColumn("relative_humidity_pct", (F.col("level_index") * 13.0 % 110).cast("double"))
    return texts.with_depression(rows).select("hour_id", "level_index", F.round("dew_point_depression_c", 5).alias("dew_point_depression_c"))


@R.add("d20_fraction_maps", "with c as (select p_size % 10 as place, p_brand as code, count(*) as n from part group by all), t as (select *, n / sum(n) over (partition by place) as share from c) select place, code, round(share, 6) as share from t where share >= 0.0005")
def d20_fraction_maps(spark, d):
    c = table(spark, d, "part").select((F.col("p_size") % 10).alias("place"), F.col("p_brand").alias("code"))
    shares = series.class_shares(c.withColumn("code", F.col("code")), "place", "code", nodata="")
    return texts.fractions_map(shares, "place", "code").select("place", F.explode("fractions").alias("code", "share")).withColumn("share", F.round("share", 6))


@R.add(
    "c01_coherence",
    """with m as (select c_nationkey as site, c_custkey // 2 * 2 + case when c_nationkey % 5 = 0 then 0 else c_custkey % 2 end as member, case when c_nationkey % 5 = 2 and c_custkey % 3 = 0 then 'B' else 'A' end as zone, case when c_nationkey % 5 = 3 then c_custkey % 2 else 1 end as launch, case when c_nationkey % 5 = 4 and c_custkey % 4 = 0 then 'x' else 'y' end as th, case when c_nationkey % 10 = 1 and c_custkey % 7 = 0 then 2 else 1 end as voc from customer)
select site, count(*) as members, case when count(distinct member) < count(*) then 'duplicate member' when count(distinct voc) > 1 then 'vocabulary' when count(distinct zone) > 1 then 'zone' when count(distinct launch) > 1 then 'launch' when count(distinct th) > 1 then 'thresholds' end as problem from m group by site""",
)
def c01_coherence(spark, d):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    m = table(spark, d, "customer").select(
        n.alias("site"),
        (F.floor(k / 2) * 2 + F.when(n % 5 == 0, 0).otherwise(k % 2)).alias("member"),
        F.when((n % 5 == 2) & (k % 3 == 0), "B").otherwise("A").alias("zone"),
        F.when(n % 5 == 3, k % 2).otherwise(1).alias("launch_m"),
        F.when((n % 5 == 4) & (k % 4 == 0), "x").otherwise("y").alias("thresholds"),
        F.when((n % 10 == 1) & (k % 7 == 0), 2).otherwise(1).alias("vocabulary"),
    )
    return texts.coherence(m)


_FOUND = {"thermalWindow": "f01_thermal_window", "quietDay": "f03_quiet_day", "liftCeiling": "f04_lift_ceiling", "capTiming": "f05_cap_timing", "bandShear": "f11_band_shear", "dataCaveats": "f13_data_caveats"}


@R.add("u01_every_finding", " union all ".join(f"select '{k}' as kind, {texts.KINDS.index(k)} as kind_order, count(*) as n from ({finding_plans.R.sql[q]}) as {q}" for k, q in _FOUND.items()))
def u01_every_finding(spark, d):
    h = shared_hours(spark, d, levels=True)
    frames = {"thermalWindow": findings.thermal_windows(h), "quietDay": findings.quiet_days(h), "liftCeiling": findings.lift_ceilings(h), "capTiming": findings.cap_timing(h), "bandShear": findings.band_shear(h), "dataCaveats": findings.data_caveats(h, ("usable_lift_top_m", "boundary_layer_top_m"))}
    return texts.every_finding(frames).groupBy("kind", "kind_order").agg(F.count("*").alias("n"))


@R.add(
    "t08_elevation_pick",
    "with c as (select l_orderkey as place_id, case when l_linenumber % 3 = 0 then 'map' else 'survey' end as source, case when l_linenumber % 3 <> 0 then year(l_shipdate) end as year, case when l_quantity > 20 then l_extendedprice end as elevation_m from lineitem) select place_id, arg_min(source, (case when source = 'survey' then 0 else 1 end, -coalesce(year, 0), elevation_m)) as source, arg_min(elevation_m, (case when source = 'survey' then 0 else 1 end, -coalesce(year, 0), elevation_m)) as elevation_m from c where elevation_m is not null group by place_id",
)
def t08_elevation_pick(spark, d):
    line = F.col("l_linenumber")
    return texts.elevation_pick(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("place_id"), F.when(line % 3 == 0, "map").otherwise("survey").alias("source"), F.when(line % 3 != 0, F.year("l_shipdate")).alias("year"), F.when(F.col("l_quantity") > 20, F.col("l_extendedprice")).alias("elevation_m")))
