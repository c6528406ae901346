"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Nulls: a null text is judged, compared, mixed and encoded as the empty text and stays null until it is encoded; a null id or source is a value like
others. Ties: of a group of near duplicates the row with the smallest id stays (of equal ids and texts, any one). Repeated rows are near duplicates of each other; those
without words are no one's, and all stay. Very long texts are treated whole. An empty table stays empty. Columns besides those of documents pass through all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelift.llm import common, mixing, near_dup, pieces, quality, secret_scan


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels, does not reject."""
    source = common.table(spark, sf_dir, "documents")
    return quality.keep_good(docs, quality.learn(source, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_dup.keep_one(docs, percent=80, shingle=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; n_chars follows the new text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(clean.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none to three times."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of the text, and whether decoding gives the text back."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"))
    whole = F.coalesce(F.replace("text", F.lit(pieces.MARK), F.lit(" ")), F.lit(""))
    return encoded.select("doc_id", "source", "ids", F.size("ids").alias("n_ids"), (F.col("decoded") == whole).alias("round_trip"), "parity")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]

#: Trained rules, MinHash and the tokenizer are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; what each kept is written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
