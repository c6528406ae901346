"""Ranked lexical search: for each item the documents that score highest on its terms, found in a document FP-tree.

A document's vector is restricted to the terms that occur in any item and ordered by their frequency over all documents, frequent terms
first, so that documents share the paths of a trie. Each node stands for the documents below it: it holds, for every term in its subtree, the
maximum of tf, and the minimum of m, the length norm. As a term's share of a score grows with tf and falls with m, these bound the score of every
document of the subtree, and for a single document they are its score. Per item the tree is searched depth first, best child first; a subtree whose bound, or at
an equal bound whose smallest id, cannot enter the item's best k is left out.

Two passes: the first writes the restricted vectors of all documents, and what is summed over them (documents, terms, documents that hold each term of an
item). The second makes trees of up to `BLOCK_ENTRIES` entries, block after block of a task, and carries each item's best k from block to block; a task hands out k rows an
item at most, and these meet in two steps of ranking.

Items are read in batches of about `ITEM_BYTES` of text, by a hash of their id and text, and a pass is made for each batch: so what is sent to the
executors is bounded however many items there are.

Scores are integers (see `weight` and `impact`). Nulls: a null text has no terms, so such a document is never found and such an item finds nothing; null
document ids rank after others of an equal score. Ties go to the smaller id. Repeated rows of documents are documents of their own; an item that repeats with its text counts once. A very long
text is counted whole. An empty table of either kind gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Share of the length in the norm, per cent, and the norm's factor.
LENGTH_SHARE, NORM = 90, 8
ONE = 1_000_000_000
TEXT_AT_ONCE = 4 << 20
ITEM_BYTES = 8 << 20
#: Entries of restricted vectors in a tree, and documents that a node is not split below.
BLOCK_ENTRIES = 2_000_000
LEAF = 48
NO_ID = 2**63 - 1


def _separators() -> np.ndarray:
    """Bytes of a text with A-Z lower-cased and all that is no part of a term turned into spaces."""
    to = np.arange(256, dtype=np.uint8)
    to[ord("A") : ord("Z") + 1] += 32
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        to[low : high + 1] = 32
    return to


BYTES = _separators()


def term_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code of each term, number of terms of each text, the distinct terms."""
    texts = pa.concat_arrays([texts])  # offsets from 0
    upto = int(pc.sum(pc.binary_length(texts)).as_py() or 0)
    data = BYTES[np.frombuffer(texts.buffers()[2], np.uint8)[:upto]] if upto else np.zeros(0, np.uint8)
    return words.word_codes(pa.StringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data)))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: int, n_docs: int, n_terms: int, share: int = LENGTH_SHARE) -> int:
    return 100 - share + share * n * n_docs // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (ONE * tf) // (1000 * tf + NORM * m)


class Tree:
    """The FP-tree of a block. Nodes stand in breadth-first order, so a node's children follow each other, and the documents are the children of the leaves."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray, np.ndarray]]):
        """docs: id, m, ranks of the terms in ascending order, tf. No vector may be empty."""
        docs = sorted(docs, key=lambda d: d[2].astype(">u4").tobytes())  # along the paths of the trie
        self.ids = np.array([d[0] for d in docs], np.int64)
        self.m = np.array([d[1] for d in docs], np.int64)
        self.ranks, self.tf = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
        self.ends = np.cumsum([len(d[2]) for d in docs])
        self.starts = self.ends - [len(d[2]) for d in docs]
        self.low, self.high = [0], [len(docs)]
        self.children: list[tuple[int, int] | None] = []
        at, depths = 0, [0]
        while at < len(self.low):
            cuts, depth = self.split(self.low[at], self.high[at], depths[at])
            self.children.append((len(self.low), len(self.low) + len(cuts) - 1) if len(cuts) else None)
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                self.low.append(int(low))
                self.high.append(int(high))
                depths.append(depth)
            at += 1
        self.least_id = np.array([self.ids[a:b].min() for a, b in zip(self.low, self.high, strict=True)])
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high, strict=True)])
        self.bounds: list = [None] * len(self.low)
        maxima: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at in range(len(self.low) - 1, -1, -1):  # children stand after their node
            maxima[at] = self.fold(at, maxima)

    def split(self, low: int, high: int, depth: int) -> tuple[np.ndarray, int]:
        """Where the next term of the paths changes, after the part that all of [low, high) share; nothing for a leaf."""
        while high - low > LEAF:
            at = self.starts[low:high] + depth
            inside = at < self.ends[low:high]
            step = np.where(inside, self.ranks[np.minimum(at, len(self.ranks) - 1)], -1)
            cuts = np.flatnonzero(np.diff(step)) + 1
            depth += 1
            if len(cuts):
                return np.concatenate([[low], low + cuts, [high]]), depth
            if not inside[0]:
                break
        return np.zeros(0, np.int64), depth

    def fold(self, at: int, maxima: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sets what bounds a node's children (terms, impacts, where each child's begin) and gives the node's own maxima (terms, tf)."""
        if self.children[at] is None:
            docs = slice(self.low[at], self.high[at])
            span = slice(self.starts[docs][0], self.ends[docs][-1])
            terms, tf, n, m = self.ranks[span], self.tf[span], self.ends[docs] - self.starts[docs], self.m[docs]
        else:
            first, last = self.children[at]
            own = [maxima.pop(c) for c in range(first, last)]
            terms, tf, n, m = np.concatenate([t for t, _ in own]), np.concatenate([x for _, x in own]), np.array([len(t) for t, _ in own]), self.least_m[first:last]
        self.bounds[at] = (terms, impact(tf, np.repeat(m, n)), np.cumsum(n) - n)
        order = np.argsort(terms, kind="stable")
        terms, tf = terms[order], tf[order]
        new = np.flatnonzero(np.diff(terms, prepend=-1))
        return terms[new], np.maximum.reduceat(tf, new)


def best_of(tree: Tree, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
    """Adds the tree's documents to best, a heap of (score, -id) of at most k. weights: of every rank, 0 but for the item's terms."""
    open_nodes = [(NO_ID, -1, 0)]
    while open_nodes:
        bound, least, at = open_nodes.pop()
        if len(best) == k and (bound, -least) <= best[0]:
            continue
        terms, shares, starts = tree.bounds[at]
        scores = np.add.reduceat(weights[terms] * shares, starts)
        floor = best[0][0] if len(best) == k else 1
        found = np.flatnonzero(scores >= max(floor, 1))
        if tree.children[at] is None:
            ids = tree.ids[tree.low[at] + found]
            order = np.lexsort((ids, -scores[found]))[:k]  # of many equal copies those with the smallest ids
            for score, doc in zip(scores[found[order]].tolist(), ids[order].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, -doc))
                elif (score, -doc) > best[0]:
                    heapq.heapreplace(best, (score, -doc))
                else:
                    break
        else:
            first = tree.children[at][0]
            order = found[np.argsort(scores[found], kind="stable")]  # the best child is taken next
            open_nodes += [(score, int(tree.least_id[first + c]), first + c) for score, c in zip(scores[order].tolist(), order.tolist(), strict=True)]


def vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """docs: doc_id, text. Of every document with a term: doc_id, n, terms (places in the vocabulary, ascending) and tf."""

    def run(batches):
        for b in words.slices(batches, at_most=TEXT_AT_ONCE):
            codes, n, distinct = term_codes(b.column("text"))
            place = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = place[codes] if len(codes) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            found, tf = np.unique(row[place >= 0] * len(vocabulary) + place[place >= 0], return_counts=True)
            size = np.bincount(found // max(1, len(vocabulary)), minlength=len(n))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(x.astype(np.int32))) for x in (found % max(1, len(vocabulary)), tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tf array<int>")


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_ENTRIES) -> Iterator[list[tuple]]:
    """Documents of a task as (id, n, terms, tf), in lists of about `most` entries."""
    docs, entries = [], 0
    for b in batches:
        ids = pc.fill_null(b.column("doc_id").cast(pa.int64()), NO_ID).to_pylist()
        ends = np.cumsum(pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
        terms, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tf"))
        low = 0
        for doc, n, high in zip(ids, b.column("n").to_pylist(), ends.tolist(), strict=True):
            docs.append((doc, n, terms[low:high], tf[low:high]))
            entries += high - low
            low = high
            if entries >= most:
                yield docs
                docs, entries = [], 0
    if docs:
        yield docs


def _search_batch(docs: DataFrame, items: pa.Table, k: int) -> DataFrame | None:
    """One pass. items: item_id, text, few enough to be sent to the executors."""
    codes, n, distinct = term_codes(pc.fill_null(items.column("text").combine_chunks().cast(pa.string()), ""))
    kept = common.stored(vectors(docs, distinct))
    n_docs, n_terms = kept.agg(F.count("*"), F.sum("n")).head()
    if not n_docs:
        return None
    df = np.zeros(len(distinct), np.int64)
    for r in kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the items
        df[r["term"]] = r["count"]
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weights_of = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
    terms_of = [np.unique(t) for t in np.split(codes, np.cumsum(n)[:-1])]
    asked = [(rank[t[df[t] > 0]], weights_of[t[df[t] > 0]]) for t in terms_of]
    item_ids = items.column("item_id").combine_chunks()

    def run(batches):
        from pyspark import TaskContext

        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        weights = np.zeros(len(rank), np.int64)
        for block in blocks(batches):
            made = []
            for doc, length, terms, tf in block:
                ranks = rank[terms]
                order = np.argsort(ranks)
                made.append((doc, norm(length, n_docs, n_terms), ranks[order], tf[order]))
            tree = Tree(made)
            for (ranks, own), heap in zip(asked, best, strict=True):
                weights[ranks] = own
                best_of(tree, weights, heap, k)
                weights[ranks] = 0
        flat = [(item, None if doc == -NO_ID else -doc, score) for item, heap in enumerate(best) for score, doc in heap]
        item, doc, score = zip(*flat, strict=True) if flat else ((), (), ())
        part = np.full(len(flat), TaskContext.get().partitionId() // 64, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), item_ids.take(pa.array(item, pa.int32())), pa.array(doc, pa.int64()), pa.array(score, pa.int64()), pa.array(part)], ["item", "item_id", "doc_id", "score", "part"])

    kind = docs.sparkSession.createDataFrame(items.slice(0, 1)).schema["item_id"].dataType.simpleString()
    found = kept.where(F.size("terms") > 0).mapInArrow(run, f"item int, item_id {kind}, doc_id bigint, score bigint, part int")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: of each item (item_id, text) its k best documents (doc_id, text) with a score above 0."""
    items = items.select("item_id", "text").where("text is not null").distinct()
    held = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    batches = -(-held // ITEM_BYTES)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) if batches else None
    found = [_search_batch(docs, items.where(place == at).orderBy("item_id", "text").toArrow(), k) for at in range(batches)]
    kind = items.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for df in found:
        out = df if df is not None and len(found) == 1 else out.unionByName(df) if df is not None else out
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
with d as (select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as w from documents),
t as (select row_no, doc_id, unnest(w) as term from d),
s as (select count(distinct row_no)::bigint as n_docs, count(*)::bigint as n_terms from t),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as term from benchmark),
m as (select row_no, (10 + (90 * count(*) * any_value(n_docs)) // any_value(n_terms))::bigint as m from t, s group by row_no),
f as (select row_no, any_value(doc_id) as doc_id, term, count(*)::bigint as tf from t where term in (select term from q) group by row_no, term),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, s group by term),
r as (select item_id, doc_id, row_no, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join f using (term) join w using (term) join m using (row_no) group by item_id, doc_id, row_no),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as place from r where score > 0)
select item_id, place::int as rank, doc_id, score from k where place <= {TOP}
"""
