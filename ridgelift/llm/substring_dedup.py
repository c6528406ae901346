"""Suffix-array dedup: removes every byte that a repeated string of `length` bytes covers.

Suffixes are dealt into buckets, and one bucket at a time is sorted. A bucket holds the suffixes whose first `length` bytes have
the same smallest gram hash, so equal strings always share a bucket. A run of neighbouring suffixes of one text in one bucket
travels as one context, the bytes they span, not as a copy per suffix. Buckets in which the gram occurs once in the
whole corpus cannot hold a repeat and are left out before any text moves. Equal contexts are merged: strings of a context seen twice are all repeated.

Inside a bucket suffixes are sorted by their bytes: first by v of them, v a divisor of the length. Long ties are resolved by
ranks of a difference cover: sample positions whose residues modulo v cover all differences, ranked beforehand by the length - v
bytes that follow. For any two tied suffixes the cover names a shift at which both are samples; the order of their ranks there, then of the
last v bytes, is the suffixes' order, and equal ranks mean equal bytes. Suffixes whose hash is alone in the block equal no other and are not sorted.

Memory is bounded by the block of `BLOCK` bytes that is sorted at once. A bucket of more than `SPLIT` bytes of distinct contexts is split by the next smallest gram
of its strings, again and again up to `LEVELS` grams. What is then still larger holds much the same strings: it is sorted block by block, and of equal strings one goes on to
the next block, so a task keeps the bucket's distinct strings.

Nulls: a null text is the empty text: 0 bytes. Texts shorter than the length have no such string and lose nothing. Repeated rows
repeat each other, so all their strings are removed. Null ids are kept apart by their text. A very long text is read in steps of `STEP` bytes. An empty table gives an
empty result. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

LENGTH = 400
BLOCK = 1 << 20
SPLIT = 2 << 20
LEVELS = 4
STEP = 2 << 20
MULTIPLIER = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)])) for m in (MULTIPLIER, inverse))
    return up, down


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each position on."""
    n = len(data)
    size = 1 << max(10, (n + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters()[data] * up[:n], out=total[1:])
    if n < length:
        return np.zeros(0, np.uint64)
    return words.mix64((total[length:] - total[:-length]) * down[: n - length + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours."""
    n = len(x)
    whole = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    whole[:n] = x
    whole = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(whole, 1).ravel()
    back = np.minimum.accumulate(whole[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def gram_of(length: int) -> int:
    return max(1, min(64, length // 4))


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one smallest gram: hash, first start, last start, occurrences of the gram in their span."""
    gram = gram_of(length)
    w = length - gram + 1
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(0, len(data) - length + 1), STEP):
        part = data[at : at + STEP + length - 1]
        g = rolling(part, gram)
        m = sliding_min(g, w)
        lo = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        hi = np.concatenate([lo[1:] - 1, [len(m) - 1]])
        h = m[lo]
        marked = np.zeros(1 << 20, bool)
        marked[h & np.uint64((1 << 20) - 1)] = True
        where = np.flatnonzero(marked[g & np.uint64((1 << 20) - 1)])
        values, code = np.unique(g[where], return_inverse=True)
        key = np.sort(code.astype(np.int64) * (len(g) + 1) + where)
        own = np.searchsorted(values, h).astype(np.int64) * (len(g) + 1)
        for column, v in zip(out, (h.view(np.int64), lo + at, hi + at, np.searchsorted(key, own + hi + w) - np.searchsorted(key, own + lo)), strict=True):
            column.append(v)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


@cache
def difference_cover(v: int) -> tuple[tuple[int, ...], np.ndarray]:
    """Residues modulo v that cover all differences, and shift[a][b] with a + shift and b + shift both among them."""
    chosen, missing = [0], set(range(1, v))
    while missing:
        best = max(range(v), key=lambda c: len({(c - d) % v for d in chosen} & missing | {(d - c) % v for d in chosen} & missing))
        missing -= {(best - d) % v for d in chosen} | {(d - best) % v for d in chosen}
        chosen.append(best)
    inside = np.zeros(v, bool)
    inside[chosen] = True
    shift = np.zeros((v, v), np.int64)
    for a in range(v):
        for b in range(v):
            shift[a, b] = next(s for s in range(v) if inside[(a + s) % v] and inside[(b + s) % v])
    return tuple(sorted(chosen)), shift


def modulus_of(length: int) -> int:
    return next(v for v in range(min(80, length // 2), 0, -1) if length % v == 0)


def _ranks(data: np.ndarray, at: np.ndarray, v: int) -> np.ndarray:
    """Places in byte order of the v bytes from each position on; equal bytes share one."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, v)[at])
    rank = np.zeros(len(at), np.int64)
    for c in range(0, v, 8):  # eight bytes at a time, as one big-endian number
        part = rows[:, c : c + 8]
        part = np.pad(part, ((0, 0), (0, 8 - part.shape[1]))) if part.shape[1] < 8 else np.ascontiguousarray(part)
        word = np.unique(part.view(">u8").ravel().astype(np.uint64), return_inverse=True)[1]
        rank = np.unique(rank << 32 | word, return_inverse=True)[1]
    return rank


def _within(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which positions lie in one of the ranges, both ends included."""
    edges = np.bincount(first, minlength=size + 1)[: size + 1] - np.bincount(last + 1, minlength=size + 1)[: size + 1]
    return np.cumsum(edges)[:size] > 0


def classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start (sorted) the index of a start with the same `length` bytes: equal strings get the same one."""
    label = np.arange(len(starts))
    hashes = rolling(data, length)[starts]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twin = np.zeros(len(starts), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    who = np.flatnonzero(twin)
    if not len(who):
        return label
    v = modulus_of(length)
    cover, shift = difference_cover(v)
    p = starts[who]
    head, tail = _ranks(data, p, v), _ranks(data, p + length - v, v)
    inside = np.zeros(v, bool)
    inside[list(cover)] = True
    residue = inside[np.arange(len(data)) % v]
    sampled = np.flatnonzero(residue & _within(len(data), p, p + length - v))
    by_place = np.full(len(data), -1)
    by_place[sampled] = _ranks(data, sampled, v)
    # ranks of the sample by the length - v bytes that follow, v bytes more each time
    sample = np.flatnonzero(residue & _within(len(data), p, p + v - 1))
    rank = by_place[sample]
    for j in range(1, length // v - 1):
        rank = np.unique(rank << 32 | by_place[sample + j * v], return_inverse=True)[1]
    rank_of = np.full(len(data), -1)
    rank_of[sample] = rank

    left = np.argsort(head, kind="stable")
    group = head[left]
    while len(left):  # quicksort of all ties at once: each meets its own pivot, what is equal is done
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(begins, len(left)))
        pivot = np.repeat(left[begins + sizes // 2], sizes)
        s = shift[p[left] % v, p[pivot] % v]
        sign = np.sign(rank_of[p[left] + s] - rank_of[p[pivot] + s])
        sign = np.where(sign == 0, np.sign(tail[left] - tail[pivot]), sign)
        equal = sign == 0
        label[who[left[equal]]] = who[pivot[equal]]
        left, group = left[~equal], (np.repeat(np.arange(len(begins)), sizes) * 2 + (sign > 0))[~equal]
        order = np.argsort(group, kind="stable")
        left, group = left[order], group[order]
    return label


def _ranges(which: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Start and end of the bytes that strings at the marked offsets cover, as unions of neighbours."""
    at = np.flatnonzero(which)
    if not len(at):
        return [], []
    cut = np.flatnonzero(at[1:] - at[:-1] > length)
    return at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + length).tolist()


RANGES = "h bigint, digest binary, starts array<bigint>, ends array<bigint>"


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["h", "digest", "starts", "ends"])


@dataclass
class _Context:
    h: int
    digest: bytes
    offset: int  # of the bytes in the whole context
    data: bytes
    repeats: bool  # the whole context was seen twice
    told: np.ndarray | None = None  # strings already given out


def _solve(contexts: list[_Context], length: int) -> tuple[list[tuple], list[_Context]]:
    """Ranges that repeated strings cover, and one copy of each string of the last bucket, to be met by the bucket's next block."""
    data = np.frombuffer(b"".join(c.data for c in contexts), np.uint8)
    begin = np.cumsum([0, *(len(c.data) for c in contexts)])
    counts = [len(c.data) - length + 1 for c in contexts]
    label = classes(data, np.concatenate([np.arange(b, b + n) for b, n in zip(begin, counts, strict=False)]), length)
    again = np.bincount(label, minlength=len(label))[label] > 1
    first = np.zeros(len(label), bool)
    first[np.unique(label, return_index=True)[1]] = True
    out, kept, at = [], [], 0
    for c, n in zip(contexts, counts, strict=True):
        found, alone = again[at : at + n] | c.repeats, first[at : at + n]
        at += n
        told = np.zeros(n, bool) if c.told is None else c.told
        a, b = _ranges(found & ~told, length)
        if a:
            out.append((c.h, c.digest, [c.offset + x for x in a], [c.offset + x for x in b]))
        if c.h == contexts[-1].h:
            told = found | told
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], alone, [0]])))
            kept += [_Context(c.h, c.digest, c.offset + i, c.data[i : j + length - 1], False, told[i:j]) for i, j in cuts.reshape(-1, 2).tolist()]
    return out, kept


def _sort_blocks(length: int, block: int):
    """Rows sorted by bucket: sorts whole buckets up to a block at once, and a larger bucket block by block."""

    def run(batches):
        held: list[_Context] = []
        size, most = 0, block
        for batch in batches:
            for h, digest, data, n in zip(*(batch.column(c).to_pylist() for c in ("h", "digest", "context", "n")), strict=True):
                if size > most:
                    out, kept = _solve(held, length)
                    yield _batch_of(out)
                    held = kept if h == held[-1].h else []
                    size = sum(len(c.data) for c in held)
                    most = max(block, 2 * size)
                held.append(_Context(h, digest, 0, data, n > 1))
                size += len(data)
        if held:
            yield _batch_of(_solve(held, length)[0])

    return run


def _cut(length: int, level: int):
    """Cuts contexts of one bucket into runs of strings that share the next smallest gram too."""
    gram = gram_of(length)
    w, most = length - gram + 1, np.uint64(2**64 - 1)
    names = ["h", "digest", "offset", "child", "child_digest", "context", "n"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for h, digest, data, n in zip(*(batch.column(c).to_pylist() for c in ("h", "digest", "context", "n")), strict=True):
                g = rolling(np.frombuffer(data, np.uint8), gram)
                for _ in range(level):  # grams that all of its strings share
                    g = np.where(g == g[:w].min(), most, g)
                m = sliding_min(g, w)
                lo = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
                child = words.mix64(np.array([h], np.int64).view(np.uint64) * np.uint64(MULTIPLIER) + m[lo]).view(np.int64)
                for a, b, key in zip(lo.tolist(), [*lo[1:].tolist(), len(m)], child.tolist(), strict=True):
                    part = data[a : b + length - 1]
                    rows.append((h, digest, a, key, hashlib.blake2b(part, digest_size=16).digest(), part, n))
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _ranges_of(distinct: DataFrame, length: int, keep, level: int = 1) -> DataFrame:
    """distinct: contexts h, digest, context, n, each once. The ranges that repeated strings cover in each, in one row or more."""
    parts = common.partitions(distinct.sparkSession)
    sort = lambda df: df.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_sort_blocks(length, BLOCK), RANGES)
    if level >= LEVELS:
        return sort(distinct)
    large = keep(distinct.groupBy("h").agg(F.sum(F.length("context")).alias("size")).where(F.col("size") > SPLIT).select("h"))
    if not large.head(1):
        return sort(distinct)
    pieces = keep(distinct.join(large, "h").select("h", "digest", "context", "n").mapInArrow(_cut(length, level), "h bigint, digest binary, offset bigint, child bigint, child_digest binary, context binary, n bigint"))
    children = keep(pieces.groupBy(F.col("child").alias("h"), F.col("child_digest").alias("digest")).agg(F.first("context").alias("context"), F.sum("n").alias("n")))
    below = _ranges_of(children, length, keep, level + 1).select(F.col("h").alias("child"), F.col("digest").alias("child_digest"), "starts", "ends")
    moved = lambda c: F.transform(c, lambda x: x + F.col("offset")).alias(c)
    back = pieces.select("h", "digest", "offset", "child", "child_digest").join(below, ["child", "child_digest"]).select("h", "digest", moved("starts"), moved("ends"))
    return sort(distinct.join(large, "h", "left_anti")).unionByName(back)


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per key of a document (_id, _th) the byte ranges to remove: array `spans` of (start, end), unordered, maybe overlapping."""
    keyed = docs.select(*common.row_key(), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find_runs(batches):
        for b in words.slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, th, text in zip(b.column("_id").to_pylist(), b.column("_th").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                h, lo, hi, occurs = runs(np.frombuffer(text, np.uint8), length)
                for column, v in zip(out, ([doc] * len(h), [th] * len(h), h, lo, hi, occurs), strict=True):
                    column.append(v)
            flat = [pa.array([x for part in c for x in part]) if i < 2 else pa.array(np.concatenate(c) if c else [], pa.int64()) for i, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([flat[0].cast(b.schema.field("_id").type), flat[1].cast(pa.int64()), *flat[2:]], ["_id", "_th", "h", "lo", "hi", "occurs"])

    with common.scratch(docs.sparkSession) as keep:
        return common.stored(_spans(keyed, kind, find_runs, length, keep))


def _spans(keyed: DataFrame, kind: str, find_runs, length: int, keep) -> DataFrame:
    found = keep(keyed.mapInArrow(find_runs, f"_id {kind}, _th bigint, h bigint, lo bigint, hi bigint, occurs bigint"))
    again = found.groupBy("h").agg(F.sum("occurs").alias("n")).where("n > 1").select("h")
    of_text = found.join(again, "h").groupBy("_id", "_th").agg(F.collect_set(F.struct("h", "lo", "hi")).alias("runs"))

    def cut_contexts(batches):
        seen: set = set()  # one copy of equal contexts a task is enough
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, th, text, found_runs in zip(b.column("_id").to_pylist(), b.column("_th").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                raw = text.encode()
                for r in found_runs:
                    context = raw[r["lo"] : r["hi"] + length]
                    digest = hashlib.blake2b(context, digest_size=16).digest()
                    fresh = digest not in seen
                    if fresh and len(seen) < 1_000_000:
                        seen.add(digest)
                    for column, v in zip(out, (doc, th, r["lo"], r["h"], digest, context if fresh else None), strict=True):
                        column.append(v)
                if len(out[0]) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types(b), strict=True)], ["_id", "_th", "lo", "h", "digest", "context"])
                    out = [[], [], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types(b), strict=True)], ["_id", "_th", "lo", "h", "digest", "context"])

    def types(b):
        return [b.schema.field("_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    with_text = keyed.join(of_text, common.same_key(keyed, of_text)).select(keyed["_id"], keyed["_th"], common.text_or_empty(F.col("text")).alias("text"), "runs")
    contexts = keep(with_text.mapInArrow(cut_contexts, f"_id {kind}, _th bigint, lo bigint, h bigint, digest binary, context binary"))
    distinct = keep(contexts.groupBy("h", "digest").agg(F.first("context", ignorenulls=True).alias("context"), F.count("*").alias("n")))
    ranges = _ranges_of(distinct, length, keep)
    placed = contexts.select("_id", "_th", "lo", "h", "digest").join(ranges, ["h", "digest"])
    spans = placed.select("_id", "_th", F.explode(F.arrays_zip("starts", "ends")).alias("r"), "lo")
    return spans.groupBy("_id", "_th").agg(F.collect_set(F.struct((F.col("lo") + F.col("r.starts")).alias("start"), (F.col("lo") + F.col("r.ends")).alias("end"))).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    spans = covered(docs, length)
    keyed = docs.select(*common.row_key(), common.text_or_empty(F.col("text")).alias("text"))
    joined = keyed.join(spans, common.same_key(keyed, spans), "left").select(keyed["_id"].alias("doc_id"), "text", "spans")

    def run(batches):
        for b in words.slices(batches):
            out: list[list] = [[], [], [], []]
            for text, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw, own = text.encode(), merged(s)
                kept, at = [], 0
                for a, e in own:
                    kept.append(raw[at:a])
                    at = e
                kept.append(raw[at:])
                for column, v in zip(out, (len(raw), sum(e - a for a, e in own), len(own), b"".join(kept)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
