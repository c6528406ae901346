"""Small documents that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def tables(spark, path, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
