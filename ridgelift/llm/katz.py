"""LM scoring: a Katz backoff model of words, of any order from two on (two by default).

P(w | h) = d(c(h w)) * c(h w) / c(h) where the n-gram was seen in training, and a(h) * P(w | h') where it was not, h' being h without
its first word; a history never seen passes on to h' alone. P(w) in turn is discounted, and what it leaves is the probability of
the unknown word. Discounts of each order are Good-Turing's for counts up to `TOP`, from the order's own counts of counts; where
these are too few for all of the factors to lie between 0 and 1, the largest count that works takes the place of `TOP`, and if none
does, one absolute discount. a(h) is exact: what the seen n-grams leave, over what their words leave of the lower order, so every
history's probabilities sum to one. A history whose n-grams are all too frequent to be discounted counts one more event, which
is its leftover; so does the unigram distribution.

Texts become slices of about `SLICE` bytes, each written once with its own small list of words. Tables, one for each order, are dealt into
buckets: words by their hash, n-grams by their history and, where the history is frequent, by the next word too. A message from a slice
to a bucket is one row of packed columns with equal n-grams summed, and a bucket's messages are folded as they stream by:
a task holds one slice, or one bucket's distinct n-grams (about `BUCKET` tokens), whatever the size of the corpus. Word counts go back to the slices the
same way, so no list of all words exists on the driver or in a worker. Scoring sends each slice's n-grams to the buckets of
the highest order; what is not found there goes on, with the weight, to the next lower order's; sums per text go back to the slice.

Words and histories of two or more words are told apart by 64-bit hashes.

Nulls: a null text is the empty text: its one token is the end. Ties: words and n-grams of equal counts have equal discounts, so no order among them matters. A null id counts as the empty text in the split. Repeated rows
are trained on and scored once each. A very long text is a slice of its own. Without training rows every token is unknown and has
probability 1. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

TOP = 5
#: Tokens of a bucket.
BUCKET = 1_000_000
SLICE = 4 << 20
#: Entries that a fold holds before it sums them up.
FOLD = 1_000_000
#: The hash of the end: no word holds white space.
END = int(words.hashes(pa.array(["\n"]))[0])
#: Word ids: words of the training texts come after these.
UNKNOWN, START, FIRST = 0, 1, 2
TIMES, SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5BD1E995)


def discounts(n: list[int]) -> list[float]:
    """d(1..TOP) from the counts of counts n[1..TOP+1] (n[0] unused): Good-Turing up to the largest count for which all lie in (0, 1)."""
    for k in range(TOP, 0, -1):
        if all(n[1 : k + 2]):
            a = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a != 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return d + [1.0] * (TOP - k)
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5  # too few counts: one absolute discount
    return [1 - flat / r for r in range(1, TOP + 1)]


# Packed columns: unsigned numbers with their bytes regrouped by significance, and compressed.


def _pack(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    width = b[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def _differences(x: np.ndarray) -> np.ndarray:
    """Of neighbours, modulo 2**64: small where x is sorted."""
    return np.diff(x, prepend=np.uint64(0))


class _Rows:
    """Rows of a mapInArrow function, given out a batch at a time."""

    def __init__(self, schema: dict[str, pa.DataType]):
        self.schema, self.size = schema, 0
        self.columns: dict[str, list] = {c: [] for c in schema}

    def add(self, **row) -> None:
        for c, held in self.columns.items():
            held.append(row.get(c))
            self.size += 16 + (len(row[c]) if isinstance(row.get(c), bytes) else 0)

    def full(self) -> bool:
        return self.size > 4 << 20

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(v, self.schema[c]) for c, v in self.columns.items()], list(self.schema))
        self.columns, self.size = {c: [] for c in self.schema}, 0
        return batch


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in schema.items())


def _mapped(df: DataFrame, schema: dict[str, str], each) -> DataFrame:
    """each(row, add) for every row of df, a dict; add(column=value, ...) gives a row out."""

    def run(batches):
        rows = _Rows({c: _ARROW[t] for c, t in schema.items()})
        for b in batches:
            for i in range(b.num_rows):
                each({c: b.column(c)[i].as_py() for c in b.schema.names}, rows.add)
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return df.mapInArrow(run, _ddl(schema))


def _deal(add, bucket: np.ndarray, columns: dict[str, np.ndarray], first: str, **constant) -> None:
    """One row for each bucket with its part of the columns; `first` is the one they are sorted by."""
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    for own, i, j in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        part = order[i:j]
        add(bucket=own, **constant, **{c: _pack(_differences(x[part]) if c == first else x[part]) for c, x in columns.items()})


def _read(row: dict, first: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {c: np.cumsum(_unpack(row[c]), dtype=np.uint64) if c == first else _unpack(row[c]) for c in names}


def _summed(columns: dict[str, np.ndarray], keys: tuple[str, ...], number: str) -> dict[str, np.ndarray]:
    """One entry for each key, in order, with its numbers summed; other columns follow from the key."""
    order = np.lexsort([columns[k] for k in reversed(keys)])
    columns = {c: x[order] for c, x in columns.items()}
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= columns[k][1:] != columns[k][:-1]
    first = np.flatnonzero(new)
    return {c: np.add.reduceat(x, first) if c == number else x[first] for c, x in columns.items()} if len(order) else columns


def _by_bucket(df: DataFrame, *then: str) -> DataFrame:
    return df.repartition(common.partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket", *then)


def _fold(messages: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], schema: dict[str, str], done) -> DataFrame:
    """Sums column c of each bucket's messages by key as they stream by; done(bucket, columns, add) gives out the sums."""
    most = FOLD

    def run(batches):
        rows = _Rows({c: _ARROW[t] for c, t in schema.items()})
        held: list[dict] = []
        size, last = 0, None

        def whole():
            return _summed({c: np.concatenate([h[c] for h in held]) for c in names}, keys, "c")

        for b in batches:
            for i in range(b.num_rows):
                bucket = b.column("bucket")[i].as_py()
                if held and bucket != last:
                    done(last, whole(), rows.add)
                    held, size = [], 0
                last = bucket
                held.append(_read({c: b.column(c)[i].as_py() for c in names}, keys[0], names))
                size += len(held[-1]["c"])
                if size > max(most, 2 * len(held[0]["c"])):
                    held = [whole()]
                    size = len(held[0]["c"])
                if rows.full():
                    yield rows.take()
        if held:
            done(last, whole(), rows.add)
        yield rows.take()

    return _by_bucket(messages).mapInArrow(run, _ddl(schema))


def _serve(table: DataFrame, asked: DataFrame, schema: dict[str, str], load, answer) -> DataFrame:
    """load(rows of the table) once for each bucket, then answer(what was loaded, row, add) for each row asked, as they stream by."""
    both = table.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches):
        rows = _Rows({c: _ARROW[t] for c, t in schema.items()})
        own: list[dict] = []
        last, loaded = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if row["bucket"] != last:
                    last, own, loaded = row["bucket"], [], None
                if row["kind"] == 0:
                    own.append(row)
                    continue
                if loaded is None:
                    loaded, own = load(own), []
                answer(loaded, row, rows.add)
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return _by_bucket(both, "kind").mapInArrow(run, _ddl(schema))


# Slices.


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted hashes of the distinct tokens, the place among them of every token, ends included, and the tokens of each text."""
    codes, n, distinct = words.word_codes(texts)
    hashes, place = np.unique(np.concatenate([words.hashes(distinct), np.array([END], np.uint64)]), return_inverse=True)
    inner = np.ones(len(codes) + len(n), bool)
    inner[np.cumsum(n + 1) - 1] = False
    out = np.full(len(inner), len(place) - 1, np.int64)
    out[inner] = codes
    return hashes, place[out], n + 1


def slices_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, held_out, text. One row a slice: its words and their training counts, the words of every token by place."""
    kind, size = docs.schema["doc_id"].dataType.simpleString(), SLICE

    def run(batches):
        from pyspark import TaskContext

        for k, part in enumerate(words.slices(batches, at_most=size)):
            hashes, place, n = _coded(part.column("text"))
            learnt = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), n)
            trained = np.bincount(place[learnt], minlength=len(hashes))
            one = pa.array([0, part.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, part.column(c)) for c in ("doc_id", "held_out")]
            packed = [pa.array([_pack(x)], pa.binary()) for x in (n, place, _differences(hashes), trained)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()), *lists, *packed], ["slice", "doc_id", "held_out", "n", "place", "h", "c"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"slice bigint, doc_id array<{kind}>, held_out array<boolean>, n binary, place binary, h binary, c binary")


def _words_of(slices: DataFrame, buckets: int) -> DataFrame:
    def each(row, add):
        x = _read(row, "h", ("h", "c"))
        _deal(add, (x["h"] % np.uint64(buckets)).astype(np.int64), x, "h", slice=row["slice"])

    return _mapped(slices.select("slice", "h", "c"), {"bucket": "int", "slice": "bigint", "h": "binary", "c": "binary"}, each)


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, TOP + 2).astype(np.int64), minlength=TOP + 3)[: TOP + 2].tolist()


def word_table(slices: DataFrame, buckets: int) -> DataFrame:
    """Words of the training texts by bucket: h, c (counts) and id, the more frequent the smaller; tokens, and counts of counts."""

    def done(bucket, x, add):
        x = {c: v[x["c"] > 0] for c, v in x.items()}
        rank = np.empty(len(x["c"]), np.uint64)
        rank[np.argsort(-x["c"].astype(np.int64), kind="stable")] = np.arange(len(rank), dtype=np.uint64)
        add(bucket=bucket, h=_pack(_differences(x["h"])), c=_pack(x["c"]), id=_pack(rank * np.uint64(buckets) + np.uint64(bucket + FIRST)), n=_counts_of_counts(x["c"]), words=len(rank), tokens=int(x["c"].sum()))

    schema = {"bucket": "int", "h": "binary", "c": "binary", "id": "binary", "n": "array<bigint>", "words": "bigint", "tokens": "bigint"}
    return _fold(_words_of(slices, buckets), ("h",), ("h", "c"), schema, done)


def _known(table: DataFrame, slices: DataFrame, buckets: int) -> DataFrame:
    """Of each slice's words, bucket by bucket: id (UNKNOWN, if of no training text) and count."""

    def load(rows):
        found = [(np.cumsum(_unpack(r["h"]), dtype=np.uint64), _unpack(r["id"]), _unpack(r["c"])) for r in rows]
        return found[0] if found else (np.zeros(0, np.uint64),) * 3

    def answer(table, row, add):
        h, ids, c = table
        asked = np.cumsum(_unpack(row["h"]), dtype=np.uint64)
        at = np.minimum(np.searchsorted(h, asked), max(0, len(h) - 1))
        seen = h[at] == asked if len(h) else np.zeros(len(asked), bool)
        own = [np.where(seen, x[at] if len(h) else 0, 0) for x in (ids, c)]
        add(bucket=row["bucket"], slice=row["slice"], id=_pack(own[0]), c=_pack(own[1]))

    return _serve(table.select("bucket", "h", "id", "c"), _words_of(slices, buckets).select("bucket", "slice", "h"), {"bucket": "int", "slice": "bigint", "id": "binary", "c": "binary"}, load, answer)


def _joined(slices: DataFrame, known: DataFrame, buckets: int, tokens: int, size: int) -> DataFrame:
    """The slices with ids and counts of their words, and each text's tokens, known tokens and base score."""
    kind = slices.schema["doc_id"].dataType.elementType.simpleString()

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        hashes, n, place = np.cumsum(_unpack(row["h"]), dtype=np.uint64), _unpack(row["n"]).astype(np.int64), _unpack(row["place"]).astype(np.int64)
        order = np.argsort((hashes % np.uint64(buckets)).astype(np.int64), kind="stable")
        ids, c = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
        answers = answers.sort_values("bucket")
        ids[order], c[order] = (np.concatenate([_unpack(x) for x in answers[k]]) for k in ("id", "c"))
        starts = np.cumsum(n) - n
        base = np.add.reduceat(np.log10((c + 1.0) / (tokens + size + 1))[place], starts)
        known = np.add.reduceat((c > 0)[place].astype(np.int64), starts)
        texts = int(c[np.searchsorted(hashes, np.uint64(END))])
        return pd.DataFrame({"slice": [row["slice"]], "doc_id": [row["doc_id"]], "held_out": [row["held_out"]], "n_tokens": [n], "n_known": [known], "base": [base], "place": [row["place"]], "id": [_pack(ids)], "c": [_pack(c)], "texts": [texts]})

    schema = f"slice bigint, doc_id array<{kind}>, held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, place binary, id binary, c binary, texts bigint"
    return slices.groupBy("slice").cogroup(known.groupBy("slice")).applyInPandas(run, schema)


# N-grams.


def _bucket_of(a: np.ndarray, b: np.ndarray, salts: np.ndarray, buckets: int) -> np.ndarray:
    return ((words.mix64(a + np.uint64(1)) % np.uint64(buckets) + words.mix64(b ^ SALT) % salts) % np.uint64(buckets)).astype(np.int64)


def _grams(row: dict, order: int, buckets: int, tokens: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of every token of a slice: b (the word), low (its count), and for each order m its history a{m} and over how many buckets that is dealt, k{m}; the place of its text."""
    ids, counts, place = (_unpack(row[c]) for c in ("id", "c", "place"))
    b, low = ids[place.astype(np.int64)], counts[place.astype(np.int64)]
    n = np.asarray(row["n_tokens"], np.int64)
    t = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(b)) - (np.cumsum(n) - n)[t]
    out = {"b": b, "low": low}
    a = least = None
    for m in range(2, order + 1):
        before, of_before = np.full(len(b), np.uint64(START)), np.full(len(b), np.uint64(row["texts"]))
        inner = np.flatnonzero(at >= m - 1)
        before[inner], of_before[inner] = b[inner - m + 1], low[inner - m + 1]
        a = before if a is None else words.mix64(a * TIMES + before + np.uint64(1))
        least = of_before if least is None else np.minimum(least, of_before)
        # a history is at most as frequent as its rarest word: dealt over several buckets if it may fill a quarter of one
        out[f"a{m}"], out[f"k{m}"] = a, np.maximum(1, np.ceil(least * (4.0 * buckets / max(1, tokens)))).astype(np.uint64)
    return out, t


def _columns(m: int) -> tuple[str, ...]:
    """What a message of order m holds of a token: of the lower orders too, for those that are not found."""
    return (*(f"{x}{i}" for i in range(m, 1, -1) for x in "ak"), "b", "low")


def _table_columns(m: int) -> tuple[str, ...]:
    return (f"a{m}", f"k{m}", "b", "c", *(("low",) if m == 2 else (f"a{m - 1}", f"k{m - 1}")))


def gram_counts(coded: DataFrame, m: int, buckets: int, tokens: int) -> DataFrame:
    """The n-grams of order m of the training texts with their counts c, by bucket; counts of counts."""
    names = _table_columns(m)

    def each(row, add):
        x, t = _grams(row, m, buckets, tokens)
        learnt = ~np.asarray(row["held_out"], bool)[t]
        if not learnt.any():
            return
        x = {c: v[learnt] for c, v in x.items()} | {"c": np.ones(int(learnt.sum()), np.uint64)}
        x = _summed({c: x[c] for c in names}, (f"a{m}", "b"), "c")
        _deal(add, _bucket_of(x[f"a{m}"], x["b"], x[f"k{m}"], buckets), x, f"a{m}")

    def done(bucket, x, add):
        add(bucket=bucket, n=_counts_of_counts(x["c"]), **{c: _pack(_differences(v) if c == f"a{m}" else v) for c, v in x.items()})

    packed = {"bucket": "int", **dict.fromkeys(names, "binary")}
    sent = _mapped(coded.select("slice", "held_out", "n_tokens", "place", "id", "c", "texts"), packed, each)
    return _fold(sent, (f"a{m}", "b"), names, packed | {"n": "array<bigint>"}, done)


@dataclass
class Order:
    """A table of n-grams: `grams` by bucket, and `sums` of histories that are dealt over several buckets, a row for each of those."""

    m: int
    d: list[float]
    grams: DataFrame
    sums: DataFrame | None = None


@dataclass
class Katz:
    unigrams: DataFrame
    coded: DataFrame  # the slices
    buckets: int
    every: int  # tokens of all documents
    tokens: int  # of the training documents
    words: int
    d: list[float]
    n: list[int]
    orders: dict[int, Order]

    def word_probability(self):
        """P(w) from the count of w, 0 for the unknown word: a function that tasks can carry."""
        lost = [(1 - x) * r * n for r, (x, n) in enumerate(zip(self.d, self.n[1:], strict=False), 1)]
        left, events = sum(lost), self.tokens
        if not left:  # nothing is discounted: one more event
            left, events = 1, events + 1
        factor = np.array([0.0, *self.d, 1.0])

        def p(c: np.ndarray) -> np.ndarray:
            return np.where(c > 0, factor[np.minimum(c, TOP + 1).astype(np.int64)] * c, float(left)) / events

        return p


def _kept(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d, 1.0])[np.minimum(c, TOP + 1).astype(np.int64)] * c


def _histories(a: np.ndarray) -> np.ndarray:
    """Where each history of a sorted column starts."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return np.flatnonzero(new)


def _sums(row: dict, m: int, d: list[float], p) -> tuple[np.ndarray, ...]:
    """Of a bucket's table: its columns, and per history a, k, discounted counts s, lower-order mass q of the seen words, count ca."""
    x = _read(row, f"a{m}", _table_columns(m))
    first = _histories(x[f"a{m}"])
    q = np.frombuffer(row["q"], np.float64) if m > 2 else np.add.reduceat(p(x["low"]), first)
    return x, x[f"a{m}"][first], x[f"k{m}"][first], np.add.reduceat(_kept(x["c"], d), first), q, np.add.reduceat(x["c"], first)


def _hot_sums(grams: DataFrame, m: int, d: list[float], p, buckets: int) -> DataFrame:
    def each(row, add):
        _, a, k, s, q, ca = _sums(row, m, d, p)
        for i in np.flatnonzero(k > 1).tolist():
            add(a=int(a[i].view(np.int64)), own=int(words.mix64(a[i : i + 1] + np.uint64(1))[0] % np.uint64(buckets)), k=int(k[i]), s=float(s[i]), q=float(q[i]), ca=float(ca[i]))

    part = _mapped(grams, {"a": "bigint", "own": "bigint", "k": "bigint", "s": "double", "q": "double", "ca": "double"}, each)
    whole = part.groupBy("a", "own", "k").agg(*(F.sum(c).alias(c) for c in ("s", "q", "ca")))
    # a history stands in each of its buckets once, even where there are fewer buckets than salts
    placed = whole.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.least("k", F.lit(buckets)) - 1)))
    dealt = placed.select("a", "s", "q", "ca", ((F.col("own") + F.col("salt")) % buckets).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").agg(*(F.collect_list(c).alias(f"hot_{c}") for c in ("a", "s", "q", "ca")))  # few: together they fill a bucket


def _loader(m: int, d: list[float], p):
    """Reads what `_serve` gives of a bucket into arrays to look n-grams up in."""

    def load(rows):
        a, s, q, ca = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0)
        g, c = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for row in rows:
            if row["hot_a"] is None:
                x, own, k, *sums = _sums(row, m, d, p)
                cold = k == 1
                a, s, q, ca = (np.concatenate([u, v[cold]]) for u, v in zip((a, s, q, ca), (own, *sums), strict=True))
                g, c = words.mix64(x[f"a{m}"] * TIMES + x["b"]), x["c"]
            else:
                a = np.concatenate([a, np.array(row["hot_a"], np.int64).view(np.uint64)])
                s, q, ca = (np.concatenate([u, np.array(row[f"hot_{v}"], float)]) for u, v in zip((s, q, ca), ("s", "q", "ca"), strict=True))
        order = np.argsort(g)
        g, kept = g[order], np.log10(_kept(c[order], d))
        order = np.argsort(a)
        a, s, q, ca = a[order], s[order], q[order], ca[order]
        full = ca - s < 1e-9 * ca  # nothing is discounted: one more event
        events = ca + full
        weight = np.where(full, 1 / np.maximum(events, 1), 1 - s / np.maximum(events, 1)) / np.maximum(1 - q, 1e-12)
        return g, kept, a, np.log10(weight), np.log10(events)

    return load


def _look_up(table, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seen, log10 P where seen, log10 of the backoff weight where not)."""
    g, kept, histories, weight, events = table
    if not len(histories):
        return np.zeros(len(a), bool), np.zeros(len(a)), np.zeros(len(a))
    of = np.minimum(np.searchsorted(histories, a), len(histories) - 1)
    met = histories[of] == a
    weight, events = np.where(met, weight[of], 0.0), np.where(met, events[of], 0.0)
    if not len(g):
        return np.zeros(len(a), bool), np.zeros(len(a)), weight
    asked = words.mix64(a * TIMES + b)
    at = np.minimum(np.searchsorted(g, asked), len(g) - 1)
    seen = g[at] == asked
    return seen, np.where(seen, kept[at] - events, 0.0), weight


def _with_mass(grams: DataFrame, lower: Order, p, buckets: int) -> DataFrame:
    """A table of order three or more with q: for each history the lower order's probabilities of its seen words, all of them seen there too."""
    m = lower.m + 1
    a, k = f"a{m - 1}", f"k{m - 1}"

    def each(row, add):
        x = _read(row, f"a{m}", _table_columns(m))
        first = _histories(x[f"a{m}"])
        t = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff([*first, len(x["b"])]))
        order = np.lexsort((x["b"], x[a]))
        part = {c: v[order] for c, v in {a: x[a], "b": x["b"], "t": t}.items()}
        _deal(add, _bucket_of(part[a], part["b"], x[k][order], buckets), part, a, back=row["bucket"])

    def answer(table, row, add):
        x = _read(row, a, (a, "b", "t"))
        _, log, _ = _look_up(table, x[a], x["b"])
        t, back = np.unique(x["t"], return_inverse=True)
        add(bucket=row["back"], t=_pack(t), part=np.bincount(back, 10.0**log).tobytes())

    asked = _mapped(grams, {"bucket": "int", "back": "int", a: "binary", "b": "binary", "t": "binary"}, each)
    answers = _serve(_table(lower), asked.withColumnRenamed(a, "asked_a").withColumnRenamed("b", "asked_b"), {"bucket": "int", "t": "binary", "part": "binary"}, _loader(lower.m, lower.d, p), lambda table, row, add: answer(table, row | {a: row["asked_a"], "b": row["asked_b"]}, add))

    def run(own: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        q = np.zeros(len(_histories(np.cumsum(_unpack(own[f"a{m}"].iloc[0]), dtype=np.uint64))))
        for row in sums.itertuples(index=False):
            q[_unpack(row.t).astype(np.int64)] += np.frombuffer(row.part, np.float64)
        return own.assign(q=[q.tobytes()])

    return grams.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in grams.schema)}, q binary")


def _table(order: Order) -> DataFrame:
    return order.grams.unionByName(order.sums, allowMissingColumns=True)


def build(docs: DataFrame, order: int = 2) -> Katz:
    """docs: doc_id, held_out, text. Trains on the rows that are not held out."""
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    with common.scratch(spark) as written:
        slices = written(slices_of(docs))
        sizes = _mapped(slices.select("n", "h"), {"tokens": "bigint", "words": "bigint"}, lambda row, add: add(tokens=int(_unpack(row["n"]).sum()), words=len(_unpack(row["h"]))))
        tokens, places = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).head()
        parts = common.partitions(spark)
        of_words = max(parts, -(-places // BUCKET))
        table = common.stored(word_table(slices, of_words))
        n = [0] * (TOP + 2)
        for r in table.select(F.posexplode("n").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect():
            n[r["r"]] = r["n"]
        learnt, size = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).head()
        known = written(_known(table, slices, of_words))
        coded = common.stored(_joined(slices, known, of_words, learnt, size))
    model = Katz(table, coded, max(parts, -(-tokens // BUCKET)), tokens, learnt, size, discounts(n), n, {})
    p = model.word_probability()
    for m in range(2, order + 1):
        grams = common.stored(gram_counts(coded, m, model.buckets, tokens))
        n = [0] * (TOP + 2)
        for r in grams.select(F.posexplode("n").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect():
            n[r["r"]] = r["n"]
        if m > 2:
            grams = common.stored(_with_mass(grams, model.orders[m - 1], p, model.buckets))
        d = discounts(n)
        model.orders[m] = Order(m, d, grams, common.stored(_hot_sums(grams, m, d, p, model.buckets)))
    return model


def score(model: Katz) -> DataFrame:
    """One row for each row of the documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    order, buckets, every, tokens, p = max(model.orders), model.buckets, model.every, model.tokens, model.word_probability()
    def each(row, add):
        x, t = _grams(row, order, buckets, every)
        x = {c: x[c] for c in _columns(order)} | {"t": t.astype(np.uint64), "c": np.ones(len(t), np.uint64)}
        x = _summed(x, (f"a{order}", "b", "t"), "c")
        _deal(add, _bucket_of(x[f"a{order}"], x["b"], x[f"k{order}"], buckets), x, f"a{order}", slice=row["slice"])

    asked = _mapped(model.coded.select("slice", "n_tokens", "place", "id", "c", "texts"), {"bucket": "int", "slice": "bigint", **dict.fromkeys((*_columns(order), "t", "c"), "binary")}, each)
    parts = None
    for m in range(order, 1, -1):
        names = (*_columns(m), "t", "c")
        renamed = asked.select("bucket", "slice", *(F.col(c).alias(f"asked_{c}") for c in names))

        def answer(table, row, add, m=m, names=names):
            x = _read({c: row[f"asked_{c}"] for c in names}, f"a{m}", names)
            seen, log, weight = _look_up(table, x[f"a{m}"], x["b"])
            value = np.where(seen, log, weight + (np.log10(p(x["low"])) if m == 2 else 0.0)) * x["c"]
            t, back = np.unique(x["t"], return_inverse=True)
            add(slice=row["slice"], t=_pack(t), part=np.bincount(back, value).tobytes())
            if m > 2 and not seen.all():
                on = {c: x[c][~seen] for c in (*_columns(m - 1), "t", "c")}
                by = np.lexsort((on["b"], on[f"a{m - 1}"]))
                on = {c: v[by] for c, v in on.items()}
                _deal(add, _bucket_of(on[f"a{m - 1}"], on["b"], on[f"k{m - 1}"], buckets), {f"on_{c}": v for c, v in on.items()}, f"on_a{m - 1}", slice=row["slice"])

        schema = {"slice": "bigint", "t": "binary", "part": "binary"}
        if m > 2:
            schema |= {"bucket": "int", **{f"on_{c}": "binary" for c in (*_columns(m - 1), "t", "c")}}
        given = _serve(_table(model.orders[m]), renamed, schema, _loader(m, model.orders[m].d, p), answer)
        if m > 2:
            given = common.stored(given)
            asked = given.where("bucket is not null").select("bucket", "slice", *(F.col(f"on_{c}").alias(c) for c in (*_columns(m - 1), "t", "c")))
        own = given.where("part is not null").select("slice", "t", "part")
        parts = own if parts is None else parts.unionByName(own)

    coded = model.coded.select("slice", "doc_id", "held_out", "n_tokens", "n_known", "base")
    kind = coded.schema["doc_id"].dataType.elementType.simpleString()

    def gather(facts: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        f = facts.iloc[0]
        total = np.zeros(len(f["n_tokens"]))
        for row in sums.itertuples(index=False):
            total[_unpack(row.t).astype(np.int64)] += np.frombuffer(row.part, np.float64)
        ids = list(f["doc_id"])
        ids = pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64") if kind in ("bigint", "int") else ids
        return pd.DataFrame({"doc_id": ids, "held_out": list(f["held_out"]), "n_tokens": f["n_tokens"], "n_known": f["n_known"], "train_tokens": tokens, "base_score": f["base"], "score": total})

    return coded.groupBy("slice").cogroup(parts.groupBy("slice")).applyInPandas(gather, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (common.crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    return score(build(docs))
