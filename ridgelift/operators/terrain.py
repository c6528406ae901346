"""Site context: height, slope, relief and land cover around places, from a raster of any size.

Cells belong to square tiles, and a place goes to each tile that its widest disc reaches: an equality join whose keys are no larger than a tile, however wide the raster. What a disc asks is counted per
place and land-cover class first, then put together per place, for all radii at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import geometry

from .texts import elevation_pick

#: Cells along a side of a tile.
TILE = 64
RELIEF_M, COVER_M = (1_000.0, 3_000.0, 10_000.0), (1_000.0, 3_000.0)
#: Two sources further apart than this may stand on different ground.
DISAGREEMENT_M = 100.0
# Fixed values of the plausibility check: sea-level pressure, scale height, tolerance, highest ground.
SEA_LEVEL_HPA, SCALE_HEIGHT_M, TOLERANCE_M, CEILING_M = 1013.25, 8434.0, 1000.0, 9000.0


@dataclass(frozen=True)
class Raster:
    """Where cell (row, col) lies: latitude lat0 + row * dlat, longitude lon0 + col * dlon."""

    lat0: float
    dlat: float
    lon0: float
    dlon: float
    rows: int
    cols: int

    def y(self, lat: Column) -> Column:
        return (lat - self.lat0) / self.dlat

    def x(self, lon: Column) -> Column:
        return (lon - self.lon0) / self.dlon


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def _reach(radius_m: float, raster: Raster) -> tuple[Column, Column]:
    """Rows and columns that a disc about `latitude` spans on either side, in parts of cells."""
    return F.lit(radius_m / (abs(raster.dlat) * geometry.M_PER_DEG_LAT)), F.lit(radius_m / abs(raster.dlon)) / geometry.m_per_deg_lon(F.col("latitude"))


def _on_tiles(places: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """A row of places for each tile that lies within so many rows and columns of its cell (_row, _col)."""
    tiles = lambda at, n, most: F.sequence(F.floor((at - F.ceil(n)) / TILE).cast("int"), F.floor((at + F.ceil(n)) / TILE).cast("int"))
    return places.withColumn("_ty", F.explode(tiles(F.col("_row"), rows, None))).withColumn("_tx", F.explode(tiles(F.col("_col"), cols, None)))


def _tiled(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", "z", "code", F.floor(F.col("row") / TILE).cast("int").alias("_ty"), F.floor(F.col("col") / TILE).cast("int").alias("_tx"))


def ground(places: DataFrame, cells: DataFrame, raster: Raster) -> DataFrame:
    """places: site_id, latitude, longitude. Adds surface_m (between cells), slope_deg, aspect_deg, code (of the own cell) and problem, from the nine cells around."""
    p = places.withColumn("_fy", raster.y(F.col("latitude"))).withColumn("_fx", raster.x(F.col("longitude"))).withColumn("_row", _half_up(F.col("_fy"))).withColumn("_col", _half_up(F.col("_fx")))
    dy, dx = F.col("row") - F.col("_row"), F.col("col") - F.col("_col")
    near = _on_tiles(p.select("site_id", "_row", "_col"), F.lit(1), F.lit(1)).join(_tiled(cells), ["_ty", "_tx"]).where((F.abs(dy) <= 1) & (F.abs(dx) <= 1))
    nine = [F.max(F.when((dy == r) & (dx == c), F.col("z"))).alias(f"_z{3 * r + c + 4}") for r in (-1, 0, 1) for c in (-1, 0, 1)]
    own = near.groupBy("site_id").agg(*nine, F.max(F.when((dy == 0) & (dx == 0), F.col("code"))).alias("code"))
    q = p.join(own, "site_id", "left")
    z = F.array(*[F.col(f"_z{i}") for i in range(9)])
    y0, x0 = F.floor("_fy"), F.floor("_fx")
    corner = lambda r, c: F.get(z, ((y0 - F.col("_row") + 1 + r) * 3 + x0 - F.col("_col") + 1 + c).cast("int"))
    # a place on a row of cells needs no row beyond it
    y_exact, x_exact = F.col("_fy") == y0, F.col("_fx") == x0
    low, right = lambda c: F.when(y_exact, corner(0, c)).otherwise(corner(1, c)), lambda f: F.when(x_exact, f(0)).otherwise(f(1))
    surface = geometry.bilinear(corner(0, 0), right(lambda c: corner(0, c)), low(0), right(low), F.col("_fx") - x0, F.col("_fy") - y0)
    slope, aspect = geometry.horn([F.col(f"_z{i}") for i in range(9)], geometry.m_per_deg_lon(F.col("latitude")) * abs(raster.dlon), abs(raster.dlat) * geometry.M_PER_DEG_LAT)
    whole = F.forall(z, lambda v: v.isNotNull())
    problem = F.when(surface.isNull(), "no height").when(~whole, "no slope").when(F.coalesce(F.col("code"), F.lit(0)) == 0, "no land cover")
    return q.select("site_id", "latitude", "longitude", surface.alias("surface_m"), slope.alias("slope_deg"), aspect.alias("aspect_deg"), "code", problem.alias("problem"), "_row", "_col", "_fy", "_fx")


def discs(placed: DataFrame, cells: DataFrame, raster: Raster, relief_m: tuple[float, ...] = RELIEF_M, cover_m: tuple[float, ...] = COVER_M) -> DataFrame:
    """placed: as `ground` gives them. Per site relief (radius_km, min_m, max_m, below_pct: of its heights, ties half) and cover (radius_km, by_class: shares by class, without nodata and what rounds to 0 at three digits)."""
    rows, cols = _reach(max(relief_m + cover_m), raster)
    p = _on_tiles(placed.select("site_id", "latitude", "longitude", "surface_m", "_row", "_col"), rows, cols)
    near = p.join(_tiled(cells), ["_ty", "_tx"])
    inside = lambda m: geometry.in_disc(raster.lat0 + F.col("row") * raster.dlat, raster.lon0 + F.col("col") * raster.dlon, F.col("latitude"), F.col("longitude"), m)
    near = near.where(inside(max(relief_m + cover_m)))
    counts = []
    for i, m in enumerate(relief_m):
        z = F.when(inside(m), F.col("z"))
        counts += [F.min(z).alias(f"_low{i}"), F.max(z).alias(f"_high{i}"), F.count(z).alias(f"_n{i}"), F.count_if(z < F.col("surface_m")).alias(f"_below{i}"), F.count_if(z == F.col("surface_m")).alias(f"_equal{i}")]
    counts += [F.count_if(inside(m)).alias(f"_cover{i}") for i, m in enumerate(cover_m)]
    per_class = near.groupBy("site_id", F.coalesce("code", F.lit(0)).alias("code")).agg(*counts)
    whole = per_class.groupBy("site_id").agg(
        *[f(f"{c}{i}").alias(f"{c}{i}") for i in range(len(relief_m)) for c, f in (("_low", F.min), ("_high", F.max), ("_n", F.sum), ("_below", F.sum), ("_equal", F.sum))],
        *[F.sort_array(F.collect_list(F.when((F.col("code") != 0) & (F.col(f"_cover{i}") > 0), F.struct((-F.col(f"_cover{i}")).alias("n"), "code")))).alias(f"_cover{i}") for i in range(len(cover_m))],
    )

    def shares(found: str) -> Column:
        total = F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s - x["n"])
        return F.map_from_entries(F.filter(F.transform(found, lambda x: F.struct(x["code"], (-x["n"] / total).alias("share"))), lambda x: x["share"] >= 0.0005))

    relief = F.array(*[F.struct(F.lit(m / 1000).alias("radius_km"), F.col(f"_low{i}").alias("min_m"), F.col(f"_high{i}").alias("max_m"), (100.0 * (F.col(f"_below{i}") + 0.5 * F.col(f"_equal{i}")) / F.nullif(F.col(f"_n{i}"), F.lit(0))).alias("below_pct")) for i, m in enumerate(relief_m)])
    cover = F.array(*[F.struct(F.lit(m / 1000).alias("radius_km"), shares(f"_cover{i}").alias("by_class")) for i, m in enumerate(cover_m)])
    return whole.select("site_id", relief.alias("relief"), cover.alias("cover"))


def site_context(places: DataFrame, cells: DataFrame, raster: Raster, surveys: DataFrame, names: dict[int, str], relief_m: tuple[float, ...] = RELIEF_M, cover_m: tuple[float, ...] = COVER_M) -> DataFrame:
    """The context of each place (site_id, latitude, longitude). cells: row, col, z (null: masked), code (0 or null: no data). surveys: place_id, source, year, elevation_m, the bare-earth candidates.

    The elevation is the first that a survey or map measures, else the raster's own (`surface`); `disagrees` says that the two lie far apart. A place with a problem has it told, and no context.
    """
    at = ground(places, cells, raster)
    covered = F.lit(True)
    for m in relief_m + cover_m:
        rows, cols = _reach(m, raster)
        covered = covered & (F.col("_fy") - rows >= 0) & (F.col("_fy") + rows <= raster.rows - 1) & (F.col("_fx") - cols >= 0) & (F.col("_fx") + cols <= raster.cols - 1)
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    name = F.try_element_at(known, F.col("code"))
    at = at.withColumn("problem", F.coalesce("problem", F.when(~covered, "disc crosses the edge").when(name.isNull(), "unknown land cover")))
    good = at.where("problem is null")
    picked = elevation_pick(surveys).withColumnRenamed("place_id", "site_id")
    out = good.join(discs(good, cells, raster, relief_m, cover_m), "site_id").join(picked, "site_id", "left")
    elevation = F.coalesce("elevation_m", "surface_m")
    gap = elevation - F.col("surface_m")
    empty = F.exists("relief", lambda r: r["below_pct"].isNull())
    whole = out.select("site_id", "latitude", "longitude", F.struct(F.coalesce("source", F.lit("surface")).alias("source"), elevation.alias("elevation_m"), gap.alias("gap_m"), (F.abs(gap) > DISAGREEMENT_M).alias("disagrees")).alias("elevation"), F.struct("surface_m", "slope_deg", "aspect_deg", "relief").alias("terrain"), F.struct(name.alias("at_launch"), F.col("cover").alias("fractions")).alias("land_cover"), F.when(empty, "disc without heights").alias("problem"))
    return whole.unionByName(at.where("problem is not null").select("site_id", "latitude", "longitude", "problem"), allowMissingColumns=True)


def sources_of(context: DataFrame, raster_source: str, cover_source: str) -> DataFrame:
    """The sources that a context refers to, each once: for the document's list."""
    used = F.array(F.when(F.col("elevation.source") != "surface", F.col("elevation.source")), F.lit(raster_source), F.lit(cover_source))
    return context.where("problem is null").select(F.explode(used).alias("source")).where("source is not null").distinct()


def implausible_ground(elevation_m: Column, pressure_hpa: Column) -> Column:
    """Why a model's ground cannot be: too far from what its own surface pressure implies, or higher than any on Earth; null if it can."""
    implied = F.log(F.lit(SEA_LEVEL_HPA) / pressure_hpa) * SCALE_HEIGHT_M
    return F.when(F.abs(implied - elevation_m) > TOLERANCE_M, "against its pressure").when(elevation_m > CEILING_M, "above all ground")
