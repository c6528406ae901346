"""Quality classifier: a sparse ensemble of rules.

Small regression trees are boosted on statistics of labelled texts. Every path of a tree becomes a conjunctive
rule; a lasso logistic regression keeps few of them, and the kept rules are compiled into one Spark column expression over
the statistics. Statistics and score of the corpus are thus plain JVM expressions, in one pass without a shuffle.

The trees and the lasso are fitted on the driver over a bounded sample: the `sample` labelled rows whose ids have
the smallest hashes (the sample's size is a parameter, and only its statistics leave the executors). The ids and
labels of the sample are broadcast; their number is that bound.

Nulls: a null text is the empty text. A document without any word is scored like every other, from its statistics (all
0). Null ids are scored too; null labels are not learnt from. Without usable labels of both classes every score is the
share of label 1 (1.0 if there are none). Repeated rows get equal scores; of rows with one labelled id one is learnt from, of repeated labels every different one. Empty tables
give an empty result. A very long text is scored whole. The score depends on the text alone; other columns, whatever their names, pass through `keep_good` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 12_000
THRESHOLD = 0.3
SYMBOLS = "#$%&*@~^|<>{}[]\\=+_/!"


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, by name. `w` holds its words: see `with_statistics`."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    letters_only = F.translate(text, SYMBOLS, "")
    lines = F.split(text, "\n", -1)
    n_lines = F.size(lines).cast("double")
    return {
        "n_words": F.size("_w").cast("double"),
        "word_length": F.length(text) / words,
        "distinct_words": F.size(F.array_distinct("_w")) / words,
        "symbols": (F.length(text) - F.length(letters_only)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_per_line": words / n_lines,
        "capitals": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / n,
    }


STATISTICS = ("n_words", "word_length", "distinct_words", "symbols", "distinct_lines", "words_per_line", "capitals")


def with_statistics(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """keep, and a struct `_s` of the statistics."""
    text = common.text_or_empty(F.col("text"))
    base = docs.select(*keep, text.alias("_t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"))
    kept = [c for c in base.columns if c not in ("_t", "_w")]
    return base.select(*kept, F.struct(*[c.alias(k) for k, c in statistics(F.col("_t")).items()]).alias("_s"))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, at most?, bound) that all hold; its weight is added to the score's logit."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float

    def column(self, s: str = "_s") -> Column:
        """The probability of label 1 as a column over the struct of statistics."""
        logit = F.lit(self.bias)
        for r in self.rules:
            holds = F.lit(True)
            for name, at_most, bound in r.conditions:
                x = F.col(f"{s}.{name}")
                holds = holds & ((x <= F.lit(bound)) if at_most else (x > F.lit(bound)))
            logit = logit + F.when(holds, F.lit(r.weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _tree(x: np.ndarray, g: np.ndarray, depth: int, least: int, path: tuple, out: list) -> None:
    """Grows one regression tree on residuals g; appends (path, mean) of every node below the root."""
    if path:
        out.append((path, float(g.mean())))
    if depth == 0 or len(g) < 2 * least:
        return
    best = (1e-9, None, None)
    total, n = g.sum(), len(g)
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 50)))
        place = np.searchsorted(cuts, x[:, j], side="left")
        s, c = np.cumsum(np.bincount(place, g, len(cuts) + 1))[:-1], np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
        ok = (c >= least) & (n - c >= least)
        if not ok.any():
            continue
        gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(cuts[k]))
    if best[1] is None:
        return
    _, j, cut = best
    left = x[:, j] <= cut
    _tree(x[left], g[left], depth - 1, least, (*path, (j, True, cut)), out)
    _tree(x[~left], g[~left], depth - 1, least, (*path, (j, False, cut)), out)


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, at_most, cut in path:
        ok &= (x[:, j] <= cut) if at_most else (x[:, j] > cut)
    return ok


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, rounds: int = 400) -> Model:
    """Boosted trees, their paths as rules, and lasso logistic weights by accelerated proximal steps."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return Model((), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(7)
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: dict[tuple, None] = {}
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.6
        g = y - 1 / (1 + np.exp(-f))
        nodes: list = []
        _tree(x[rows], g[rows], depth, max(10, len(y) // 500), (), nodes)
        inner = {p[:-1] for p, _ in nodes}
        for p, mean in nodes:
            paths.setdefault(p)
            if p not in inner:
                f += 0.8 * 4 * mean * _holds(x, p)
    rules = list(paths)
    if not rules:
        return Model((), float(np.log(y.mean() / (1 - y.mean()))))
    a = np.stack([_holds(x, p) for p in rules], 1).astype(float)
    scale = np.maximum(a.std(0), 0.02)
    z = (a - a.mean(0)) / scale
    step = 4 / max(np.linalg.norm(z.T @ z / len(y), 2), 1e-9)
    w = v = np.zeros(z.shape[1])
    b = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(z @ v + b))) - y
        b -= 2 * e.mean()
        moved = v - step * (z.T @ e) / len(y)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (was - 1) / t * (new - w), new
    weights = w / scale
    kept = tuple(Rule(tuple((STATISTICS[j], at_most, cut) for j, at_most, cut in p), float(c)) for p, c in zip(rules, weights, strict=True) if abs(c) > 1e-6)
    return Model(kept, float(b - (a.mean(0) * weights).sum()))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out_mod: int = 5) -> Model:
    """Learns from labelled documents whose crc32(id) mod held_out_mod is not 0."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (common.crc_mod(F.col("doc_id"), held_out_mod) != 0))
        .select("doc_id", F.col("quality").cast("double").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_y")
        .limit(sample)
    )
    ids = chosen.select(F.col("doc_id").alias("_label_id"), "_y")
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_label_id"))  # at most `sample` rows are broadcast
    # of rows with one id the first by their statistics is learnt from, so no more rows than labels leave the executors
    one = with_statistics(picked, ["doc_id", "_y"]).groupBy("doc_id", "_y").agg(F.min("_s").alias("_s"))
    rows = one.select("doc_id", "_y", "_s.*").orderBy(F.xxhash64("doc_id"), "doc_id", "_y").collect()
    x = np.array([[r[k] for k in STATISTICS] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["_y"] for r in rows], float))


def score(docs: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    """keep and `score`."""
    scored = with_statistics(docs, keep)
    return scored.select(*[c for c in scored.columns if c != "_s"], model.column().alias("score"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model does not reject, columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return score(docs, model, [row]).where(F.col("score") >= threshold).select("_row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id", (common.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
