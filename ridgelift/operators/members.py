"""What an ensemble's samples must hold before they are used: for every field and site the whole roster of members, from one grid, with one way of giving wind; and pixels that pass their quality flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rosters(samples: DataFrame, fields: DataFrame, sites: DataFrame, members: Sequence[int]) -> DataFrame:
    """samples: field, site_id, member, grid_key, along_grid (whether wind follows the grid's axes), value. One row for each field and site that is asked for: the values in the order of members, and what
    is wrong with them (the first of: nothing there, members missing, members twice, members unknown, values missing, several grids, several ways of giving wind); null if nothing is.
    """
    roster = F.array(*[F.lit(m) for m in members])
    g = samples.groupBy("field", "site_id").agg(
        F.sort_array(F.collect_list("member")).alias("_found"),  # as many as members
        F.sort_array(F.collect_list(F.struct("member", "value"))).alias("_values"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("_void"),
        F.count_distinct("grid_key").alias("_grids"),
        F.count_distinct("along_grid").alias("_ways"),
        F.first("grid_key").alias("grid_key"),
    )
    listed = lambda a: F.array_join(a, ",")
    missing, unknown = F.array_except(roster, "_found"), F.array_except("_found", roster)
    x = fields.select("field").distinct().crossJoin(sites.select("site_id").distinct()).join(g, ["field", "site_id"], "left")  # what is asked for: fields times sites
    problem = (
        F.when(F.col("_found").isNull(), "nothing there")
        .when(F.size(missing) > 0, F.concat(F.lit("members missing: "), listed(missing)))
        .when(F.size(F.array_distinct("_found")) < F.size("_found"), "members twice")
        .when(F.size(unknown) > 0, F.concat(F.lit("members unknown: "), listed(unknown)))
        .when(F.col("_void") > 0, "values missing")
        .when(F.col("_grids") != 1, "several grids")
        .when(F.col("_ways") > 1, "several ways of giving wind")
    )
    x = x.withColumn("problem", problem)
    in_order = F.transform(roster, lambda m: F.get(F.filter("_values", lambda v: v["member"] == m), F.lit(0))["value"])
    return x.select("field", "site_id", "grid_key", F.when(F.col("problem").isNull(), in_order).alias("values"), "problem")


def complete(rows: DataFrame) -> DataFrame:
    """rows of `rosters`; the job fails at the first that has a problem, naming field, site and problem."""
    told = F.concat(F.lit("incomplete ensemble: field "), F.col("field").cast("string"), F.lit(", site "), F.col("site_id").cast("string"), F.lit(": "), F.col("problem"))
    return rows.withColumn("values", F.when(F.col("problem").isNotNull(), F.raise_error(told).cast("array<double>")).otherwise(F.col("values"))).drop("problem")


def paired_winds(u: DataFrame, v: DataFrame) -> DataFrame:
    """Members' wind components of one field, as `complete` gives them: site_id, member's place, u, v. Both must be of one grid."""
    x = u.select("site_id", F.col("values").alias("u"), F.col("grid_key").alias("_g")).join(v.select("site_id", F.col("values").alias("v"), F.col("grid_key").alias("_h")), "site_id", "full_outer")
    same = F.col("_g").eqNullSafe(F.col("_h")) & F.col("_g").isNotNull()
    told = F.concat(F.lit("u and v of different grids: site "), F.col("site_id").cast("string"))
    x = x.withColumn("u", F.when(same, F.col("u")).otherwise(F.raise_error(told).cast("array<double>")))
    return x.select("site_id", F.posexplode(F.arrays_zip("u", "v")).alias("place", "w")).select("site_id", "place", "w.u", "w.v")


def gated(value: Column, flag: Column, worst: int) -> Column:
    """A pixel's value, if its quality flag is there and no worse than allowed; null otherwise."""
    return F.when(flag.isNotNull() & (flag <= worst), value)
