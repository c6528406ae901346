"""Incremental ingest of satellite granules from object listings: a stream of listing pages in, each new granule once out.

The cursor is kept with the data: the newest instant of what is committed. A run looks at keys that are newer than the cursor less `late`, so that granules which appear late are still found, and never
further back than the backfill floor; what is committed is left out by its key. A batch is written to a folder of its own and counts once its commit is there, which names it and the
cursor. A crash between the two leaves a folder that the replayed batch overwrites, and a reader sees committed batches alone.

Ties and repeats: a key that is listed twice, on one page or many, is one granule. Keys without a stamp, or with a stamp that is no instant, are passed over. Null bodies list nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelift.operators.texts import listed_keys

BACKFILL = dt.timedelta(hours=6)
LATE = dt.timedelta(hours=1)
STAMP = r"_s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})"


def scan_instant(key: Column) -> Column:
    """When the scan of a key began: year, day of the year, hour, minute and second behind `_s`; null without such a stamp."""
    year, day, hour, minute, second = (F.regexp_extract(key, STAMP, i).try_cast("int") for i in range(1, 6))
    ok = key.rlike(STAMP) & day.between(1, 366) & (hour < 24) & (minute < 60) & (second < 60)
    start = F.unix_timestamp(F.make_timestamp(year, F.lit(1), F.lit(1), hour, minute, second))
    return F.when(ok, F.timestamp_seconds(start + (day - 1) * 86_400))


def hour_folders(since: Column, until: Column) -> Column:
    """The folders (year/day of the year/hour/) that can hold scans from since to until: what a run has to list."""
    return F.transform(F.sequence(F.date_trunc("hour", since), until, F.expr("interval 1 hour")), lambda h: F.date_format(h, "yyyy/DDD/HH/"))


def fresh_keys(listings: DataFrame, published: DataFrame, now: dt.datetime | Column, backfill: dt.timedelta = BACKFILL, late: dt.timedelta = LATE, suffix: str = ".nc") -> DataFrame:
    """listings: path, body (a page of an object listing). published: key, observed_at. Keys to read, with their instants; the published rows looked at are those of the same span."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    span = published.agg(F.max("observed_at").alias("cursor")).select(F.greatest(now - F.lit(backfill), F.col("cursor") - F.lit(late)).alias("since"))
    known = published.join(F.broadcast(span), F.col("observed_at") > F.col("since")).select("key")  # one row
    keys = listed_keys(listings, suffix).select("key", scan_instant(F.col("key")).alias("observed_at"))
    found = keys.join(F.broadcast(span), F.col("observed_at") > F.col("since")).where(F.col("observed_at") <= now).select("key", "observed_at").distinct()
    return found.join(known, "key", "left_anti")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str, but: int | None = None) -> DataFrame:
    """key, observed_at, day, batch of all committed batches (but one)."""
    done = _read(spark, f"{path}/commits", "batch long, cursor timestamp, granules long").where(F.lit(but).isNull() | (F.col("batch") != F.lit(but)))
    return _read(spark, f"{path}/granules", "key string, observed_at timestamp, day string, batch long").join(F.broadcast(done.select("batch")), "batch", "left_semi")


def cursor(spark: SparkSession, path: str) -> dt.datetime | None:
    return _read(spark, f"{path}/commits", "batch long, cursor timestamp, granules long").agg(F.max("cursor")).head()[0]


def append_granules(path: str, clock: Callable[[], dt.datetime], backfill: dt.timedelta = BACKFILL, late: dt.timedelta = LATE) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over listing pages (path, body)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = fresh_keys(batch, committed(spark, path, but=batch_id), clock(), backfill, late)
        fresh.withColumn("day", F.date_format("observed_at", "yyyy-DDD")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/granules/batch={batch_id}")
        mine = _read(spark, f"{path}/granules/batch={batch_id}", "key string, observed_at timestamp, day string")
        mine.agg(F.max("observed_at").alias("cursor"), F.count("*").alias("granules")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")

    return write


def run(pages: DataFrame, path: str, checkpoint: str, clock: Callable[[], dt.datetime], **how) -> None:
    """Takes in what there is and ends. pages: a stream of path, body."""
    q = pages.writeStream.foreachBatch(append_granules(path, clock, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
