"""Publications of several families of documents at once, and readers that are pinned to one of them.

A publication writes each family's rows to a folder of its version and then one manifest row, which maps every family to the version that holds it: families that are not published anew carry over. The
manifest row is written last, so a publication that fails half-way is invisible, and a retry takes the same version and overwrites it. A reader takes one manifest row when it is
opened, and everything it loads comes from there, whatever is published meanwhile. One publisher writes to a path at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .publish import finite_or_fail

MANIFEST = "version long, published_at timestamp, families map<string,bigint>, rows map<string,bigint>"
#: What the rows of a family must carry; more columns may follow.
FAMILIES = {
    "forecast": "site_id string, model string, reference_time timestamp, generated_at timestamp, valid_at timestamp",
    "smoke": "site_id string, reference_time timestamp, valid_at timestamp, surface_ugm3 double, column_mgm2 double",
    "observation": "site_id string, observed_at timestamp, source string, value double",
    "history": "station_id string, observed_at timestamp, wind_avg_mps double",
    "runs": "model string, reference_time timestamp, generated_at timestamp",
    "sites": "site_id string, latitude double, longitude double, time_zone string",
}


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # nothing is published yet
            raise
        return spark.createDataFrame([], MANIFEST)


def contract_problem(schema: T.StructType, family: str) -> str | None:
    """Why rows of this schema are no rows of a family; null if they are."""
    want = T.StructType.fromDDL(FAMILIES[family])
    have = {f.name: f.dataType for f in schema}
    missing = [f.name for f in want if f.name not in have]
    other = [f"{f.name} ({have[f.name].simpleString()})" for f in want if f.name in have and have[f.name] != f.dataType]
    if missing:
        return f"{family} lacks {', '.join(missing)}"
    return f"{family} has {', '.join(other)}" if other else None


@dataclass(frozen=True)
class Snapshot:
    """One publication, as it was when it was opened."""

    spark: SparkSession
    path: str
    version: int
    families: dict[str, int]

    def load(self, family: str) -> DataFrame | None:
        """The family's rows; None if none were ever published. Rows that break the family's contract are refused."""
        if family not in FAMILIES:
            raise ValueError(f"{family} is no family: {', '.join(FAMILIES)}")
        if family not in self.families:
            return None
        rows = self.spark.read.parquet(f"{self.path}/{family}/version={self.families[family]}")
        problem = contract_problem(rows.schema, family)
        if problem:
            raise ValueError(f"version {self.version}: {problem}")
        return rows

    def site(self, family: str, site_id: str) -> DataFrame | None:
        rows = self.load(family)
        return None if rows is None else rows.where(F.col("site_id") == site_id)

    def reference_times(self) -> DataFrame | None:
        """The newest run of each model that this publication's runs name."""
        runs = self.load("runs")
        return None if runs is None else runs.groupBy("model").agg(F.max("reference_time").alias("reference_time"), F.max_by("generated_at", F.struct("reference_time", "generated_at")).alias("generated_at"))


def open_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The newest publication, or the one of a version; None if there is none."""
    rows = _manifest(spark, path)
    rows = rows if version is None else rows.where(F.col("version") == version)
    last = rows.agg(F.max_by(F.struct("version", "families"), "version").alias("m")).head()["m"]  # one row
    return None if last is None else Snapshot(spark, path, last["version"], dict(last["families"]))


def publish(spark: SparkSession, path: str, families: dict[str, DataFrame]) -> int:
    """Writes the families' rows and then the manifest row that makes them visible together; gives the version."""
    for family, rows in families.items():
        if family not in FAMILIES:
            raise ValueError(f"{family} is no family: {', '.join(FAMILIES)}")
        problem = contract_problem(rows.schema, family)
        if problem:
            raise ValueError(problem)
    before = open_snapshot(spark, path)
    version = 1 if before is None else before.version + 1
    counts = {}
    for family, rows in families.items():
        where = f"{path}/{family}/version={version}"
        finite_or_fail(rows).write.mode("overwrite").parquet(where)
        counts[family] = spark.read.parquet(where).count()
    held = {} if before is None else before.families
    row = spark.createDataFrame([(version, held | dict.fromkeys(families, version), counts)], "version long, families map<string,bigint>, rows map<string,bigint>")
    row.withColumn("published_at", F.current_timestamp()).select("published_at", "families", "rows").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return version
