"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local session gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # once the table is written, nothing reads the shuffles behind it again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors. For what the result is read from."""
    return _written(df)[0]


@contextmanager
def scratch(spark: SparkSession):
    """A function like `stored` whose tables are deleted in the end: for what is used up before the result is read."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = _written(df)
        paths.append(path)
        return out

    try:
        yield keep
    finally:
        for path in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def no_clash(df: DataFrame, *names: str) -> None:
    """Refuses columns of the caller that are named like those an operator adds."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are added by this operator: rename those of the input")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart even where ids repeat: rows with equal id and text give equal results."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])
