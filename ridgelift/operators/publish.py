"""Publication: merged windows, manifests and indexes, archive lines, and the guards around them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgelift.functions.numbers import exact_half_even


def merged_window(published: DataFrame, fresh: DataFrame, hours: int) -> DataFrame:
    """station_id, at, value, newly_added: fresh rows win over published ones of the same instant, the highest seq of each; a trailing window of the newest instant."""
    both = published.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    per = both.groupBy("station_id", "at").agg(F.max_by("value", F.struct("_fresh", "seq")).alias("value"), (F.min("_fresh") == 1).alias("newly_added"))
    last = per.groupBy("station_id").agg(F.max("at").alias("_last"))
    return per.join(last, "station_id").where(F.col("at") >= F.col("_last") - F.expr(f"interval {hours} hours")).drop("_last")


def runs_index(lines: DataFrame) -> DataFrame:
    return lines.groupBy("model").agg(F.max("reference_time").alias("reference_time"), F.max_by("generated_at", F.struct("reference_time", "generated_at")).alias("generated_at"))


def site_set(current: DataFrame) -> DataFrame:
    """current: site, model, reference_time. A set whose sites stand at several runs is still syncing."""
    anchor = current.groupBy("model").agg(F.max("reference_time").alias("anchor"))
    return current.join(anchor, "model").groupBy("model").agg((F.count_distinct("reference_time") > 1).alias("syncing"), F.count_if(F.col("reference_time") == F.col("anchor")).alias("current_sites"), F.count("*").alias("sites"))


def stale(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents with whether they belong to another run than the manifest names; without a manifest that is unknown (null)."""
    m = manifest.select("model", F.col("reference_time").alias("_ref"))
    return documents.join(m, "model", "left").withColumn("stale", F.col("reference_time") != F.col("_ref")).drop("_ref")


def finite_or_fail(df: DataFrame) -> DataFrame:
    """df, whose write fails naming the first column with a non-finite number: such numbers are never published."""
    checked = df
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(f.name) | (F.abs(f.name) == float("inf"))
            checked = checked.withColumn(f.name, F.when(bad, F.raise_error(F.lit(f"non-finite number in {f.name}")).cast(f.dataType)).otherwise(F.col(f.name)))
    return checked


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """df with its published columns rounded: the exact binary value, half to even."""
    return df.withColumns({c: exact_half_even(n)(F.col(c)) for c, n in digits.items()})


def ascii_json(value: Column) -> Column:
    """Compact JSON in which only ASCII is left: other characters become \\u escapes, as surrogate pairs beyond the first plane."""
    text = F.to_json(value)
    units = F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) > 1, F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")).otherwise(c))
    return F.when(text.isNotNull(), F.array_join(units, ""))


def archive_lines(runs: DataFrame, path: str) -> None:
    """Appends runs as gzipped JSON lines, by model and month; earlier files are never rewritten."""
    finite_or_fail(runs).withColumn("month", F.date_format("reference_time", "yyyy-MM")).write.mode("append").partitionBy("model", "month").option("compression", "gzip").json(path)


def read_archive(spark, path: str, schema: str, since: str | None = None) -> DataFrame:
    """Lines of an archive. `since` prunes whole months before it filters runs."""
    df = spark.read.schema(f"{schema}, model string, month string").json(path)
    return df if since is None else df.where((F.col("month") >= since[:7]) & (F.col("reference_time") >= F.lit(since).cast("timestamp")))


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/manifest").select("model", "reference_time").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # the first publication has no manifest
            raise
        return None


def publish(runs: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """Writes runs that the manifest does not list yet; the manifest comes last and makes them visible.

    Each run is a partition that a retry overwrites, so a publication that failed half-way leaves nothing double. Read with `published`.
    """
    known = _listed(runs.sparkSession, path)
    fresh = (runs if known is None else runs.join(known, ["model", "reference_time"], "left_anti")).persist(StorageLevel.MEMORY_AND_DISK)  # what is written is what is listed
    try:
        at = F.col("reference_time").cast("timestamp")
        part = F.unix_micros(at) % 1_000_000  # runs within one second stay apart
        name = F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))))
        stamped = finite_or_fail(rounded(fresh, digits or {})).withColumn("run", name)
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run").parquet(f"{path}/runs")
        fresh.groupBy("model", "reference_time").agg(F.count("*").alias("rows")).withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")
    finally:
        fresh.unpersist()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The runs that the manifest lists: those of a publication that has not ended stay invisible."""
    known = _listed(spark, path)
    runs = spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs").drop("run")
    return runs.limit(0) if known is None else runs.join(known, ["model", "reference_time"], "left_semi")
