import re

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ridgelift.llm import mixing, pieces, quality, secret_scan

from .helpers import docs, tables
from .test_dedup import near_by_force

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    rows = {r["doc_id"]: r for r in now.collect()}

    good = corpus_pipeline.keep_quality(spark, now, SF)
    scores = {r["doc_id"]: r["score"] for r in quality.op10_quality(spark, SF).collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3} and good.count() < len(rows)
    texts = [(i, rows[i]["text"]) for i, s in scores.items() if s >= 0.3]

    one = corpus_pipeline.drop_near_duplicates(spark, good, SF)
    components = near_by_force(texts, 80, 5)
    want = {i for (i, _), c in zip(texts, components, strict=True) if i == c}
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(want) and len(want) < len(texts)

    clean = corpus_pipeline.redact_secrets(spark, one, SF)
    assert clean.columns == columns and clean.count() == len(want)
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not any(len(m.group(x.group)) >= x.least for x in secret_scan.BASE_RULES for m in re.finditer(x.pattern, r["text"]))
        assert "[" in r["text"] or r["text"] == rows[r["doc_id"]]["text"]

    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    copies = {r["doc_id"]: r["_copies"] for r in mixing.with_copies(clean).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert mixed.columns == columns and got == {i: c for i, c in copies.items() if c}

    last = corpus_pipeline.encode_pieces(spark, mixed, SF).collect()
    final = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(last) == sum(got.values()) and all(r["round_trip"] and r["parity"] and r["ids"] == own.encode(final[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) for r in last)

    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids"]) for r in last)


def test_stages_of_nothing_and_of_nulls(spark):
    for df in (docs(spark, []), docs(spark, [(None, None), (1, None), (2, "")])):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            df.collect()


def test_run_over_awkward_documents(spark, tmp_path):
    """Clashing and other columns, a very long text, repeated rows with equal ids, nulls and ties, through all stages."""
    long_text = " ".join(f"word{i % 7000}" for i in range(20_000))
    base = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)] + [(50, long_text, "s0"), (60, base[0], "s1"), (60, base[0], "s1"), (None, base[1], None), (70, None, "s2"), (70, "", "s2")]
    frame = docs(spark, rows)
    for name in ("ids", "n_ids", "parity", "decoded", "score", "label", "component", "row", "_id", "size", "draw"):
        frame = frame.withColumn(name, F.lit(name))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    path = tables(spark, tmp_path, documents=frame, labels=labels)
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "source", "ids", "n_ids", "round_trip", "parity"]
    out = got.collect()
    assert all(r["n_ids"] == len(r["ids"]) and r["round_trip"] and r["parity"] for r in out)
    stage = frame
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, path)
        assert stage.columns == frame.columns
        if name == "near_dedup":
            kept = [r["text"] for r in stage.collect()]
            assert len([t for t in kept if t == base[0]]) <= 1
    assert len(out) == stage.count()
