import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgelift.llm import common, katz

from .helpers import DOCS, docs, tables

SF = "/root/testdata/sf0.001"


class Plain:
    """The model, word by word."""

    def __init__(self, texts, order=2):
        self.order, self.texts = order, [self.tokens(t) for t in texts]
        self.c = Counter(w for t in self.texts for w in t)
        self.n = sum(self.c.values())
        self.d1, self.kept = self.discounts(self.c), None
        self.left = sum((1 - self.d1[c - 1]) * c for c in self.c.values() if c <= katz.TOP)
        self.events = self.n + (not self.left)
        self.after, self.d = {}, {}
        for m in range(2, order + 1):
            grams = Counter((h, w) for t in self.texts for h, w in self.histories(t, m))
            self.d[m], self.after[m] = self.discounts(grams), defaultdict(dict)
            for (h, w), c in grams.items():
                self.after[m][h][w] = c

    @staticmethod
    def discounts(counts):
        return katz.discounts([0] + [sum(x == r for x in counts.values()) for r in range(1, katz.TOP + 2)])

    @staticmethod
    def histories(tokens, m):
        padded = [None] * (m - 1) + tokens
        return [(tuple(padded[i : i + m - 1]), w) for i, w in enumerate(tokens)]

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), "END"]

    def keep(self, c, d):
        return (d[c - 1] if c <= katz.TOP else 1) * c

    def p(self, w):
        return (self.keep(self.c[w], self.d1) if self.c[w] else self.left or 1) / max(1, self.events)

    def conditional(self, h, w):
        if not h:
            return self.p(w)
        m = len(h) + 1
        seen = self.after[m].get(h)
        if not seen:
            return self.conditional(h[1:], w)
        total = sum(seen.values())
        kept = sum(self.keep(c, self.d[m]) for c in seen.values())
        if total - kept < 1e-9 * total:
            total += 1
        if w in seen:
            return self.keep(seen[w], self.d[m]) / total
        return (1 - kept / total) / (1 - sum(self.conditional(h[1:], x) for x in seen)) * self.conditional(h[1:], w)

    def row(self, text):
        t = self.tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.n + len(self.c) + 1)) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), self.n, base, sum(math.log10(self.conditional(h, w)) for h, w in self.histories(t, self.order))


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def some(seed=1, n=120):
    rng = np.random.default_rng(seed)
    common_words = [f"w{int(i)}" for i in rng.zipf(1.6, 4000) if i < 200]
    rows = [(1, None), (2, ""), (None, "no id w1 w2"), (3, "W1 w1\tW1 é É"), (3, "W1 w1\tW1 é É"), (4, "always follows " * 30)]
    return rows + [(10 + i, " ".join(rng.choice(common_words, rng.integers(1, 80)))) for i in range(n)]


def check(got, rows, order=2):
    plain = Plain([t for i, t in rows if not held(i)], order)
    want = sorted(((i, held(i), *plain.row(t)) for i, t in rows), key=lambda x: (str(x[0]), x[5]))
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=lambda x: (str(x[0]), x[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


@pytest.mark.parametrize(("bucket", "slice_bytes", "fold"), [(katz.BUCKET, katz.SLICE, katz.FOLD), (200, 300, 50)])
def test_scores_against_a_plain_model(spark, tmp_path, monkeypatch, bucket, slice_bytes, fold):
    monkeypatch.setattr(katz, "BUCKET", bucket)
    monkeypatch.setattr(katz, "SLICE", slice_bytes)
    monkeypatch.setattr(katz, "FOLD", fold)
    rows = some()
    check(katz.op5_katz(spark, tables(spark, tmp_path, documents=docs(spark, rows))).collect(), rows)


@pytest.mark.parametrize(("order", "bucket", "slice_bytes"), [(3, 200, 500), (3, katz.BUCKET, katz.SLICE), (4, 50, 2000)])
def test_higher_orders(spark, monkeypatch, order, bucket, slice_bytes):
    monkeypatch.setattr(katz, "BUCKET", bucket)
    monkeypatch.setattr(katz, "SLICE", slice_bytes)
    rows = some(2, 60)
    df = docs(spark, rows).withColumn("held_out", common.crc_mod(F.col("doc_id"), 7) == 2)
    check(katz.score(katz.build(df, order)).collect(), rows, order)


def test_one_text_is_very_long(spark, tmp_path):
    rows = [*some(4, 20), (500, " ".join(f"x{i % 5000}" for i in range(200_000)))]
    check(katz.op5_katz(spark, tables(spark, tmp_path, documents=docs(spark, rows))).collect(), rows)


def test_frequent_words_only(spark, tmp_path):
    """No count is small enough to be discounted."""
    rows = [(i, "a b a b") for i in range(60)]
    check(katz.op5_katz(spark, tables(spark, tmp_path, documents=docs(spark, rows))).collect(), rows)


def test_packed_columns():
    for x in ([], [0], [5, 300, 0], [2**64 - 1, 7], list(range(70_000))):
        x = np.array(x, np.uint64)
        assert katz._unpack(katz._pack(x)).tolist() == x.tolist()
        assert np.cumsum(katz._unpack(katz._pack(katz._differences(x))), dtype=np.uint64).tolist() == x.tolist()


def test_corpus(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = katz.op5_katz(spark, SF).collect()
    check(got, rows)
    assert sum(r["score"] for r in got if r["held_out"]) != sum(r["base_score"] for r in got if r["held_out"])


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    plain = Plain([t for i, t in some() if not held(i)], order)
    words = [*plain.c, "UNSEEN"]
    for h in [*list(plain.after[order])[:50], ("UNSEEN",) * (order - 1)]:
        assert sum(plain.conditional(h, w) for w in words) == pytest.approx(1.0)


def test_nothing_to_score_or_to_learn(spark, tmp_path):
    assert katz.op5_katz(spark, tables(spark, tmp_path / "a", documents=spark.createDataFrame([], DOCS))).count() == 0
    only_held = [(i, "a b") for i in range(100) if held(i)]
    check(katz.op5_katz(spark, tables(spark, tmp_path / "b", documents=docs(spark, only_held))).collect(), only_held)


def test_split_agrees(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), (common.crc_mod(F.col("id"), 7) == 2).alias("held")).collect()
    assert all(r["held"] == held(r["doc_id"]) for r in rows)
