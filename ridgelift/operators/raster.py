"""Rasters as rows of cells (row, col, z; rows run southwards): slopes, samples between cells, discs. Neighbours meet by equality joins on the cell's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import geometry


def slopes(cells: DataFrame, x_m: float, y_m: float) -> DataFrame:
    """row, col, slope_deg, aspect_deg of every cell with eight neighbours, none of them masked (null)."""
    around = F.array(*[F.struct((F.col("row") - dy).alias("r"), (F.col("col") - dx).alias("c"), F.lit(i).alias("i")) for i, (dy, dx) in enumerate((y, x) for y in (-1, 0, 1) for x in (-1, 0, 1))])
    x = cells.where("z is not null").select("z", F.explode(around).alias("at")).select("at.*", "z")
    nine = x.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("i") == i, F.col("z"))).alias(f"_z{i}") for i in range(9)]).where("_n = 9")
    slope, aspect = geometry.horn([F.col(f"_z{i}") for i in range(9)], x_m, y_m)
    return nine.select("row", "col", slope.alias("slope_deg"), aspect.alias("aspect_deg"))


def samples(cells: DataFrame, points: DataFrame, lat0: float, dlat: float, lon0: float, dlon: float) -> DataFrame:
    """points: point_id, latitude, longitude. Adds z between the four cells around; null outside the raster or beside a masked cell."""
    fx, fy = (F.col("longitude") - lon0) / dlon, (F.col("latitude") - lat0) / dlat
    at = points.withColumn("_fx", fx).withColumn("_fy", fy).withColumn("_x", F.floor("_fx")).withColumn("_y", F.floor("_fy"))
    four = at.select("point_id", F.explode(F.array(*[F.struct((F.col("_y") + dy).alias("row"), (F.col("_x") + dx).alias("col"), F.lit(2 * dy + dx).alias("i")) for dy in (0, 1) for dx in (0, 1)])).alias("n")).select("point_id", "n.*")
    q = four.join(cells, ["row", "col"]).groupBy("point_id").agg(*[F.max(F.when(F.col("i") == i, F.col("z"))).alias(f"_q{i}") for i in range(4)])
    z = geometry.bilinear(*[F.col(f"_q{i}") for i in range(4)], F.col("_fx") - F.col("_x"), F.col("_fy") - F.col("_y"))
    return at.join(q, "point_id", "left").select(*points.columns, z.alias("z"))


def disc_statistics(cells: DataFrame, centres: DataFrame, radius_m: float, lat0: float, dlat: float, lon0: float, dlon: float) -> DataFrame:
    """centres: centre_id, latitude, longitude. Per centre the cells in its disc, their mean height, and how many lie below the centre's own cell, ties counting half.

    A centre meets only the cells of the rows that its disc reaches: an equality join on the row.
    """
    rows = F.lit(int(radius_m / (abs(dlat) * geometry.M_PER_DEG_LAT)) + 1)
    own = F.round((F.col("latitude") - lat0) / dlat).cast("int")
    c = centres.select("centre_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), own.alias("_row"), F.round((F.col("longitude") - lon0) / dlon).cast("int").alias("_col"))
    reach = c.withColumn("row", F.explode(F.sequence(F.col("_row") - rows, F.col("_row") + rows)))
    near = reach.join(cells.where("z is not null"), "row")
    near = near.where(geometry.in_disc(lat0 + F.col("row") * dlat, lon0 + F.col("col") * dlon, F.col("_lat"), F.col("_lon"), radius_m))
    middle = c.join(cells, (F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col"))).select("centre_id", F.col("z").alias("_z"))
    x = near.join(middle, "centre_id")
    rank = 100.0 * (F.count_if(F.col("z") < F.col("_z")) + 0.5 * F.count_if(F.col("z") == F.col("_z"))) / F.count("*")
    return x.groupBy("centre_id").agg(F.count("*").alias("cells"), F.avg("z").alias("mean_m"), rank.alias("below_pct"))
