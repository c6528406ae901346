"""Nearest neighbours: an inverted file with product-quantised residuals, searched until nothing nearer can be left.

Vectors are scaled to length 1. Coarse centroids and the codebooks of their residuals are fitted on the driver over a bounded
sample (those whose ids have the smallest hashes: `SAMPLE` vectors, and `PER_LIST` for each list, at most `MOST_LISTS` lists); every vector is indexed: it goes to its
nearest centroid's list as `parts` bytes, with the length of its residual, the length of what its bytes leave of that, and the vector itself. There are about as many lists as the root of
the number of vectors.

A query's k-th nearest among `SEEN` vectors of the sample is a score that its k-th nearest of all reaches. It goes to each list whose centroid's cosine and widest residual together reach
it; there tables of the products of its parts with all codewords give each vector's approximate cosine by table lookups, and that and the length of what the bytes leave bound the cosine from both
sides. Vectors whose upper bound falls below are left out, the others are scored, and the best go on to an exact ranking by the cosine of the original vectors in double precision. No number of
lists or candidates is fixed, so nothing is missed however the vectors lie: alike beyond what codewords tell apart, or unlike the sample. How much is left out does depend on that: clustered vectors
touch a few lists, and vectors close to random nearly all of them, which is work as for all pairs.

Lists are packed into shares of about `SHARE_ROWS` vectors, and a list that is larger is dealt over several by salts, so a list with a third of all vectors is many tasks. A query
travels once to each share that holds one of its lists, and a share's queries are dealt into blocks of about `QUERY_ROWS`. Of equal vectors in a share the k + 1 with the smallest ids
answer for all. Counts and widest residuals per list (as many rows as lists) are all that the driver sees of the index.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids or vectors of another
dimension than most of the sample. Vectors are first scaled by a power of two to components of at most 2, which changes no cosine but keeps the squares of very small or large
numbers in range. Equal scores rank by the smaller id. Rows with an id and vector
that repeat count once. An empty table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 16_384
PER_LIST = 32
MOST_LISTS = 4_096
SEEN = 4_096
SHARE_ROWS = 20_000
SHARE_BYTES = 32 << 20
QUERY_ROWS = 4_000
SLACK = 1e-9  # of a cosine: far beyond the rounding of bounds, far below what it costs


@dataclass
class Quantiser:
    centroids: np.ndarray  # (lists, dim)
    codebooks: np.ndarray  # (parts, 256, dim / parts)
    seen_ids: np.ndarray  # of some of the sample
    seen: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - (self.centroids**2).sum(1) / 2).argmax(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebooks.shape
        r = (x - self.centroids[lists]).reshape(len(x), parts, width)
        return np.stack([(r[:, p] @ b.T - (b**2).sum(1) / 2).argmax(1) for p, b in enumerate(self.codebooks)], 1).astype(np.uint8)

    def left(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What centroid and codewords leave of x."""
        words = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.codebooks)], 1)
        return x - self.centroids[lists] - words

    def reached(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """Per query a score that at least k other vectors reach; -2 where that is not known."""
        if len(self.seen) < k + 1:
            return np.full(len(x), -2.0)
        near = x @ self.seen.T
        near[ids[:, None] == self.seen_ids[None]] = -2.0
        return np.partition(near, -k, axis=1)[:, -k]

    def tables(self, q: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebooks.shape
        return np.einsum("qpw,pkw->qpk", q.reshape(len(q), parts, width), self.codebooks)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        place = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        n = np.bincount(place, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, place, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    base = base.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0))
    power = F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x)))))  # of two, in two steps: each can be written as a double
    half = F.floor(power / 2)
    scale = F.array(F.struct(F.pow(F.lit(2.0), -half).alias("a"), F.pow(F.lit(2.0), half - power).alias("b")))  # bound once a vector, not once a component
    return base.select("vec_id", F.get(F.transform(scale, lambda s: F.transform("v", lambda x: x * s["a"] * s["b"])), F.lit(0)).alias("v"))


def fit(vectors: DataFrame, sample: int = SAMPLE, lists: int | None = None) -> Quantiser | None:
    """vectors: as `usable` gives them. None without any. lists: by default about the root of their number."""
    if lists is None:
        lists = min(MOST_LISTS, max(16, int(vectors.count() ** 0.5)))
    found = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, PER_LIST * lists)).select("vec_id", "v").toArrow()
    if not found.num_rows:
        return None
    size = pc.list_value_length(found.column("v"))
    dim = min(Counter(size.to_pylist()).items(), key=lambda x: (-x[1], x[0]))[0]
    found = found.filter(pc.equal(size, dim))
    x = _matrix(found.column("v").combine_chunks(), dim)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = kmeans(x, min(lists, len(x)), 10, 1)
    parts = next(p for p in range(max(1, dim // 4), 0, -1) if dim % p == 0)
    _, first = np.unique(found.column("vec_id").to_numpy(), return_index=True)
    some = np.sort(first)[:SEEN]
    q = Quantiser(c, np.zeros((parts, 1, dim // parts)), found.column("vec_id").to_numpy()[some], x[some])
    r = (x - c[q.lists_of(x)]).reshape(len(x), parts, -1)
    size = min(256, len(x))
    q.codebooks = np.stack([kmeans(r[:, p], size, 8, 2 + p) for p in range(parts)])
    return q


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(x)], pa.binary())


def build_index(vectors: DataFrame, q: Quantiser) -> DataFrame:
    """vec_id, list, code, far (length of the residual), err (of what the code leaves of it), unit (the doubles of the scaled vector) of every usable vector."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"), q.dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            lists = q.lists_of(x)
            codes = q.encode(x, lists)
            far, err = np.linalg.norm(x - q.centroids[lists], axis=1), np.linalg.norm(q.left(x, lists, codes), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(lists, pa.int32()), _rows(codes), pa.array(far), pa.array(err), _rows(x)], ["vec_id", "list", "code", "far", "err", "unit"])

    return vectors.where(F.size("v") == q.dim).mapInArrow(run, "vec_id bigint, list int, code binary, far double, err double, unit binary")


def shares_of(sizes: dict[int, int], lists: int, most: int) -> tuple[list[int], list[int]]:
    """Per list its first share and over how many shares it is dealt: small lists fill a share together, a larger one has shares of its own."""
    first, over, share, held = [0] * lists, [1] * lists, 0, 0
    for at in range(lists):
        n = sizes.get(at, 0)
        if n > most:
            share += held > 0
            first[at], over[at] = share, -(-n // most)
            share, held = share + over[at], 0
            continue
        if held + n > most and held:
            share, held = share + 1, 0
        first[at] = share
        held += n
    return first, over


def of_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """The places of each distinct row's `most` smallest ids, in order; rows that repeat with their id once."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    new_row = np.r_[True, np.diff(same[order]) != 0]
    order = order[new_row | np.r_[True, np.diff(ids[order]) != 0]]
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[place < most])


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, q: Quantiser, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest. queries: as `usable` gives them."""
    most = max(1, min(SHARE_ROWS, SHARE_BYTES // (8 * q.dim)))
    held = {r["list"]: r for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    first, over = shares_of({i: r["n"] for i, r in held.items()}, len(q.centroids), most)
    of_list = [np.arange(a, a + n) for a, n in zip(first, over, strict=True)]
    widest = np.array([held[i]["far"] if i in held else -np.inf for i in range(len(q.centroids))])

    def ask(batches):
        for b in batches:
            x = _matrix(b.column("v"), q.dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            least = q.reached(b.column("vec_id").to_numpy(), x, k) - SLACK
            near = x @ q.centroids.T + widest >= least[:, None]
            wanted = [np.unique(np.concatenate([of_list[i] for i in np.flatnonzero(row)] or [np.zeros(0, np.int64)])) for row in near]
            row = pa.array(np.repeat(np.arange(len(x)), [len(w) for w in wanted]))
            shares = np.concatenate([*wanted, np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(row), pa.array(shares), pa.array(least).take(row), _rows(x).take(row)], ["query_id", "share", "least", "q"])

    asked = queries.where(F.size("v") == q.dim).mapInArrow(ask, "query_id bigint, share int, least double, q binary")
    placed = lambda values: F.element_at(F.from_json(F.lit(str(values)), "array<int>"), F.col("list") + 1)
    left = index.withColumn("share", (placed(first) + F.pmod(F.xxhash64("vec_id"), placed(over))).cast("int"))
    busy = asked.groupBy("share").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    left = left.join(busy, "share").select("share", "vec_id", "list", "code", "far", "err", "unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = asked.join(busy, "share").select("share", "query_id", "least", "q", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"))

    def lookup(vecs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64")})]
        if len(vecs) and len(asks):
            vecs = vecs.sort_values(["list", "vec_id"])
            x = np.frombuffer(b"".join(vecs["unit"]), float).reshape(len(vecs), -1)
            few = of_copies(vecs["vec_id"].to_numpy(), x, k + 1)
            vecs, x = vecs.iloc[few], x[few]
            ids, err = vecs["vec_id"].to_numpy(), vecs["err"].to_numpy()
            lists, start, size = np.unique(vecs["list"].to_numpy(), return_index=True, return_counts=True)
            centre, wide = q.centroids[lists], np.maximum.reduceat(vecs["far"].to_numpy(), start)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(vecs["code"]), np.uint8).reshape(len(ids), -1).T)
            for query, least, unit in zip(asks["query_id"], asks["least"], asks["q"], strict=True):
                unit = np.frombuffer(unit, float)
                middle = centre @ unit
                own = np.flatnonzero(np.repeat(middle + wide >= least, size))
                if not len(own):
                    continue
                score = np.repeat(middle, size)[own]
                table = q.tables(unit[None])[0]
                for p, code in enumerate(codes):
                    score += table[p][code[own]]
                if len(own) > k:  # one of them may be the query itself
                    least = max(least, np.partition(score - err[own], -k - 1)[-k - 1] - SLACK)
                own = own[score + err[own] >= least]
                own = own[ids[own] != query]
                near = (x @ unit)[own] if 2 * len(own) > len(x) else x[own] @ unit
                if len(near) > k:
                    best = near >= np.partition(near, -k)[-k] - SLACK
                    own, near = own[best], near[best]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[own], "near": near}))
        return pd.concat(out)

    found = left.groupBy("share", "block").cogroup(right.groupBy("share", "block")).applyInPandas(lookup, "query_id bigint, vec_id bigint, near double")
    whole = Window.partitionBy("query_id")
    found = found.withColumn("r", F.row_number().over(whole.orderBy(F.col("near").desc(), "vec_id")))
    found = found.withColumn("kth", F.max(F.when(F.col("r") == k, F.col("near"))).over(whole)).where(F.col("near") >= F.coalesce("kth", F.lit(-2.0)) - SLACK).select("query_id", "vec_id")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = queries.where(F.size("v") == q.dim).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.sqrt(dot("v", "v")).alias("qn"))
    exact = vectors.where(F.size("v") == q.dim).join(found, "vec_id").join(own, "query_id").select("query_id", "vec_id", (dot("qv", "v") / (F.col("qn") * F.sqrt(dot("v", "v")))).alias("score")).distinct()
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return exact.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(common.table(spark, sf_dir, "embeddings"))
    q = fit(vectors)
    if q is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = common.stored(build_index(vectors, q))
    return search(index, vectors, vectors.where("vec_id % 50 = 0"), q)
