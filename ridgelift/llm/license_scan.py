"""License scans: an exact set-similarity join of text blocks with licence templates.

A text is cut into overlapping blocks of words. A template matches a block when at least its threshold of
the template's distinct words occur in it (containment). Words are ordered by their document frequency over
the whole corpus, rarest first; with o = ceil(threshold * |template|), a matching block must

* share one of the |template| - o + 1 rarest template words (prefix filter),
* hold at least o template words (length filter), and
* still be able to reach o from the first shared word on (positional filter).

Words outside the templates cannot add to an overlap, so sets are kept over the template words alone; the
overlap, and with it the result, is the same. Everything runs as DataFrame operations. The only broadcast
table holds one row per word of a template's prefix: its size is fixed by the templates.

Nulls: a null text is the empty text, with no words and no labels; a null id stays null, and such rows are told apart by their texts. Words of equal frequency are ordered by their
spelling. Repeated rows each get the same result.
Input columns other than the id and the text are not read, so clashing names do no harm. An empty table gives
an empty result. Texts of any length are cut into blocks of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What separates words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between the starts of two blocks.
STRIDE = 64


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    #: A phrase counts only where its words stand consecutively.
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in self.text.lower()).split()


# The phrases that always count, and common licence notices.
PHRASES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)
NOTICES = (
    Template("mit-notice", "Released under the MIT License"),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-notice", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-notice", "This is licensed under the GNU General Public License, version 3"),
    Template("gpl-text", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("public-domain", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    # lower() also lowers letters beyond A-Z. That moves no word boundary, and of those letters only the Kelvin
    # sign becomes a plain letter, k, which no template word may hold.
    return F.filter(F.split(F.lower(common.text_or_empty(text)), SEPARATORS), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of templates: _id, _th (hash of the text), block, tid (place in templates), containment, places (word positions of a phrase)."""
    spark = docs.sparkSession
    sets = [sorted(set(t.words)) for t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    if any("k" in w for w in vocabulary):
        raise ValueError("template words must not hold the letter k: see words_of")
    overlap = max(len(t.words) for t in templates) - 1
    base = docs.select(*common.row_key(id_col, text_col), words_of(F.col(text_col)).alias("words"))

    # The global order: document frequencies of the template words, one row per word at most.
    counts = base.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counts.collect()}  # as many rows as template words at most
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}

    rows, prefix = [], set()
    for tid, (t, s) in enumerate(zip(templates, sets, strict=True)):
        need = math.ceil(t.threshold * len(s) - 1e-9)
        for i, r in enumerate(sorted(rank[w] for w in s)[: len(s) - need + 1]):
            rows.append((r, tid, i, need, len(s)))
            prefix.add(order[r - 1])
    by_word = spark.createDataFrame(rows, "r int, tid int, i int, need int, t_size int")
    rare = _strings(sorted(prefix))

    blocks = (
        base.where(F.arrays_overlap("words", rare))
        .select("_id", "_th", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRIDE).cast("int")), lambda k: F.struct(k.alias("block"), F.slice("words", k * STRIDE + 1, STRIDE + overlap).alias("w")))).alias("b"))
        .select("_id", "_th", "b.block", "b.w")
        .where(F.arrays_overlap("w", rare))
        .withColumn("ranks", F.array_sort(F.transform(F.array_intersect("w", _strings(vocabulary)), lambda t: F.array_position(_strings(order), t).cast("int"))))
    )
    pairs = (
        blocks.select("*", F.posexplode("ranks").alias("j", "r"))
        .join(F.broadcast(by_word), "r")
        .where((F.size("ranks") >= F.col("need")) & (F.col("j") <= F.size("ranks") - F.col("need")) & (F.least(F.col("t_size") - F.col("i"), F.size("ranks") - F.col("j")) >= F.col("need")))
        .groupBy("_id", "_th", "block", "tid")
        .agg(F.first("w").alias("w"), F.first("ranks").alias("ranks"), F.first("need").alias("need"), F.first("t_size").alias("t_size"))
    )
    own = F.lit(None).cast("array<int>")
    phrase = F.lit(None).cast("array<string>")
    for tid, (t, s) in enumerate(zip(templates, sets, strict=True)):
        own = F.when(F.col("tid") == tid, F.array(*[F.lit(rank[w]) for w in s])).otherwise(own)
        if t.phrase:
            phrase = F.when(F.col("tid") == tid, _strings(t.words)).otherwise(phrase)
    return (
        pairs.withColumn("shared", F.size(F.array_intersect("ranks", own)))
        .where(F.col("shared") >= F.col("need"))
        .withColumn("phrase", phrase)
        .withColumn(
            "places",
            F.when(
                F.col("phrase").isNotNull(),
                # only starts in the block's own stride: the overlap belongs to the next block
                F.transform(F.filter(F.sequence(F.lit(0), F.least(F.lit(STRIDE), F.size("w")) - 1), lambda p: F.slice("w", p + 1, F.size("phrase")) == F.col("phrase")), lambda p: p.cast("long") + F.col("block") * STRIDE),
            ),
        )
        .where(F.col("places").isNull() | (F.size("places") > 0))
        .select("_id", "_th", "block", "tid", (F.col("shared") / F.col("t_size")).alias("containment"), "places")
    )


def scan_documents(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """One row per row of docs: words, phrase places, labels and the best containment."""
    labels = F.element_at(_strings([t.label for t in templates]), F.col("tid") + 1)
    is_base = F.col("places").isNotNull()
    found = (
        scan(docs, templates)
        .groupBy("_id", "_th")
        .agg(
            F.sum(F.when(is_base, F.size("places"))).cast("long").alias("n_base"),
            F.min(F.array_min("places")).alias("first_word"),
            F.max(F.array_max("places")).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(is_base, labels))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(labels)), ",").alias("labels"),
            F.max("containment").alias("score"),
        )
    )
    every = docs.select(*common.row_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return every.join(found, common.same_key(every, found), "left").select(
        every["_id"].alias("doc_id"),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(common.table(spark, sf_dir, "documents"))
