"""Document fingerprints by a randomised edit embedding.

A text walks through shared random steps: at time t its current character c is written down, and the walk moves on
to the next character when the random bit r(t, c) says so. Two texts at a small edit distance fall into step
again soon after each edit, so the Hamming distance of what they wrote follows their edit distance.

A fingerprint keeps 64 sampled times of each octave of the walk ([0, 64), [64, 128), [128, 256), ...): four bits of the
character written at that time, 0 after the text's end. Octaves do not depend on the text's length, so texts of any
two lengths compare. The likeness of two fingerprints weighs each octave by its length: it estimates the share of
times at which both walks wrote the same. Near documents are found by banding: bits sampled from the
fingerprint of each length class are hashed per band, and members of a bucket are verified by their likeness: `near_groups`.

Nulls: a null text is the empty text; its fingerprint is all zeros, and two of them have likeness 1. Equal texts have
equal fingerprints. Ties of doc_id, and null ids (last), are ordered by the text. Texts are walked whole, in blocks, so
memory does not grow with their length. Characters beyond the first plane are folded into 16 bits, so a few of them stand for others. Ids are whole numbers;
others are refused. Columns other than doc_id and text are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .near_dup import _groups, _pairs_out

SAMPLES = 64
PERIOD = 1 << 12
CLASSES = 64
SEED = 20_240_229
BLOCK = 1 << 16
#: Members of a bucket that are compared in one task; a block of two salts holds about twice as many.
MEMBERS = 10_000
#: Text bytes of a range of ids, which one task walks as they stream by.
RANGE_BYTES = 64 << 20
#: Ranges that are cut in one go; and up to which the table of their first rows is broadcast, some 40 bytes a range.
COARSE, BROADCAST_RANGES = 1_000, 20_000
LEAST, BANDS, BITS = 0.9, 8, 24


class Walk:
    """The shared randomness: steps[c][t % PERIOD] is how long character class c stays at time t."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        bits = rng.random((CLASSES, 2 * PERIOD)) < 0.5
        bits[:, PERIOD:] = bits[:, :PERIOD]
        bits[:, [PERIOD - 1, 2 * PERIOD - 1]] = True
        after = np.empty((CLASSES, 2 * PERIOD), np.int64)
        nxt = np.full(CLASSES, 2 * PERIOD)
        for t in range(2 * PERIOD - 1, -1, -1):
            nxt = np.where(bits[:, t], t, nxt)
            after[:, t] = nxt - t + 1
        self.steps = [row[:PERIOD].tolist() for row in after]
        points = np.arange(1 << 16, dtype=np.uint64)
        mixed = (points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        self.cls = (mixed % CLASSES).astype(np.uint8)
        self.nibble = (1 + (mixed // CLASSES) % 15).astype(np.uint8)
        self.times = [np.arange(SAMPLES)]
        for k in range(1, 40):
            width = 1 << (k - 1)  # one sample in each of 64 strips of the octave
            self.times.append((SAMPLES << (k - 1)) + np.arange(SAMPLES) * width + rng.integers(0, width, SAMPLES))
        self.every_time = np.concatenate(self.times)

    def classes(self, text: str) -> np.ndarray:
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(x < 1 << 16, x, (x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)

    def run(self, points: np.ndarray, t: int, values: np.ndarray) -> int:
        """Walks through points from time t on, writes the sampled values, returns the time at the end."""
        steps, last = self.steps, PERIOD - 1
        for at in range(0, len(points), BLOCK):
            part = points[at : at + BLOCK]
            began = t
            ends = np.array([t := t + steps[c][t & last] for c in self.cls[part].tobytes()], np.int64)
            lo, hi = np.searchsorted(self.every_time, (began, t))
            values[lo:hi] = self.nibble[part[np.searchsorted(ends, self.every_time[lo:hi], side="right")]]
        return t

    def octaves(self, t: int) -> int:
        return 1 if t <= SAMPLES else 1 + int(np.ceil(np.log2(t / SAMPLES)))

    def fingerprint(self, text: str) -> str:
        points = self.classes(text)
        values = np.zeros(len(self.every_time), np.uint8)
        t = self.run(points, 0, values)
        return self.hex(values, t)

    def hex(self, values: np.ndarray, t: int) -> str:
        v = values[: SAMPLES * self.octaves(t)]
        return (v[::2] << 4 | v[1::2]).tobytes().hex()

    def pair(self, text: str, donor: str, keep: int) -> tuple[str, str]:
        """Fingerprints of text, and of its first `keep` characters followed by donor: their common part is walked once."""
        values = np.zeros(len(self.every_time), np.uint8)
        points = self.classes(text)
        t = self.run(points[:keep], 0, values)
        edited = values.copy()
        own_end = self.run(points[keep:], t, values)
        edited_end = self.run(self.classes(donor), t, edited)
        return self.hex(values, own_end), self.hex(edited, edited_end)


def likeness(a: str, b: str) -> float:
    """Estimated share of times at which both walks wrote the same; 1.0 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    n = max(len(x), len(y))
    x, y = (np.pad(v, (0, n - len(v))) for v in (x, y))
    x, y = (np.stack([v >> 4, v & 15], 1).reshape(-1, SAMPLES) for v in (x, y))
    weight = np.array([1.0] + [2.0 ** (k - 1) for k in range(1, len(x))])
    either = ((x > 0) | (y > 0)).sum(1) @ weight
    same = ((x == y) & (x > 0)).sum(1) @ weight
    return float(same / either) if either else 1.0


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Ids that cut the rows into about `ranges` equal parts, from the largest down; an id that fills several parts comes as often. Beyond `COARSE` parts each coarse one is cut by a task of its own."""
    quantiles = lambda n: F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], max(10_000, 20 * n))
    coarse = min(ranges, COARSE)
    if ranges < 2:
        return []
    known = docs.where("doc_id is not null").select("doc_id")
    bounds = sorted(known.agg(quantiles(coarse).alias("b")).head()["b"] or [], reverse=True)
    if ranges > coarse and bounds:
        fine = -(-ranges // coarse)
        parts = known.groupBy(_ranges(bounds)(F.col("doc_id"), F.xxhash64("doc_id")).alias("part")).agg(quantiles(fine).alias("b"))
        bounds = sorted(bounds + [x for r in parts.collect() for x in r["b"]], reverse=True)  # a number for each `RANGE_BYTES` of text
    return [int(x) for x in bounds]


def _ranges(bounds: list[int]):
    """A column of (id, hash of the text): the range of a row, 0 for the largest ids. An id that comes m > 1 times in the bounds has m ranges of its own, by the hash, after those of the larger ids."""
    values, times = np.unique(np.array(bounds, np.int64), return_counts=True)  # ascending
    own = np.where(times > 1, times, 0)[::-1]
    first = np.concatenate([[0], np.cumsum(own + 1)])
    ascending = values.copy()

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        x = ids.to_numpy(np.int64)
        at = len(ascending) - np.searchsorted(ascending, x, side="left")  # bounds that are not below x
        last = np.maximum(at - 1, 0)
        equal = (at > 0) & (ascending[len(ascending) - 1 - last] == x) & (own[last] > 0) if len(ascending) else np.zeros(len(x), bool)
        if not equal.any():
            return pd.Series(first[at].astype(np.int32))
        unit = np.minimum((hashes.to_numpy(np.int64) / 2.0**64 + 0.5) * own[last], own[last] - 1).astype(np.int64)
        return pd.Series(np.where(equal, first[last] + 1 + unit, first[at]).astype(np.int32))

    return place


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id and text dealt by ranges of doc_id (`_bucket`, descending), each range followed by the first row of the next (`_donor`)."""
    from pyspark.sql import Window

    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be a whole number")
    rows = docs.select("doc_id", common.text_or_empty(F.col("text")).alias("text"), F.xxhash64(common.text_or_empty(F.col("text"))).alias("_th"))
    bounds = range_bounds(docs, buckets)
    # null ids come last, in ranges of their own by the text's hash
    known = _ranges(bounds)(F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint"), F.col("_th"))
    unknown = F.lit(2 * len(bounds) + 2) + F.floor((F.col("_th") / F.lit(2.0**64) + 0.5) * buckets).cast("int")
    rows = rows.withColumn("_bucket", known).withColumn("_bucket", F.when(F.col("doc_id").isNull(), unknown).otherwise(F.col("_bucket")))
    heads = rows.groupBy("_bucket").agg(F.min(F.struct(-F.col("doc_id").cast("decimal(20,0)"), "_th")).alias("h"))
    by_place = Window.orderBy("_bucket")  # one row a range
    around = Window.partitionBy()
    heads = heads.withColumn("to", F.coalesce(F.lag("_bucket").over(by_place), F.max("_bucket").over(around)))
    heads = heads.select(F.col("_bucket").alias("_b"), F.col("h._th").alias("_hth"), (-F.col("h.col1")).cast("bigint").alias("_hid"), "to")
    if buckets <= BROADCAST_RANGES:
        heads = F.broadcast(heads)  # a row a range: three at most for each of `buckets`
    donors = rows.join(heads, (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_hid")) & (F.col("_th") == F.col("_hth")))
    donors = donors.select("doc_id", "text", "_th", F.col("to").alias("_bucket"), F.lit(True).alias("_donor"))
    return rows.withColumn("_donor", F.lit(False)).unionByName(donors).repartition(buckets, "_bucket").sortWithinPartitions("_bucket", F.col("_donor"), F.col("doc_id").desc_nulls_last(), "_th", "text")


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, object, str]]:
    """(doc_id, text, next doc_id, next text) of sorted rows; a range's first donor row follows its last row."""
    held = None
    for b in batches:
        ids, texts, places, donors = (b.column(c) for c in ("doc_id", "text", "_bucket", "_donor"))
        for i in range(b.num_rows):
            row = (ids[i].as_py(), texts[i].as_py(), places[i].as_py())
            if held is not None and held[2] == row[2]:
                yield held[0], held[1], row[0], row[1]
            held = None if donors[i].as_py() else row  # later donors, copies of the first, follow no row


def unpacked(fp: str) -> np.ndarray:
    """(octaves, SAMPLES) values of a fingerprint."""
    v = np.frombuffer(bytes.fromhex(fp), np.uint8)
    return np.stack([v >> 4, v & 15], 1).reshape(-1, SAMPLES)


def likenesses(x: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of others (octave, member, sample) have a likeness of `least` or more to x (octave, sample).

    From the heaviest octave down, a member is left out once even full agreement in the octaves to come cannot lift it to `least`.
    """
    weight = [1.0] + [2.0 ** (k - 1) for k in range(1, len(x))]
    at = np.arange(others.shape[1])
    same, either = np.zeros(len(at)), np.zeros(len(at))
    for k in range(len(x) - 1, -1, -1):
        y = others[k][at]
        same += ((y == x[k]) & (y > 0)).sum(1) * weight[k]
        either += ((y > 0) | (x[k] > 0)).sum(1) * weight[k]
        rest = SAMPLES * sum(weight[:k])
        can = same + rest >= (least - 1e-9) * (either + rest)
        at, same, either = at[can], same[can], either[can]
    near = np.zeros(others.shape[1], bool)
    near[at[np.divide(same, either, out=np.ones(len(at)), where=either > 0) >= least]] = True
    return near


def near_groups(prints: DataFrame, least: float = LEAST, bands: int = BANDS, bits: int = BITS) -> DataFrame:
    """fingerprint and `near_group`: one row for each distinct, non-null fingerprint of `prints`; groups are linked by pairs with a likeness of `least` or more.

    Each band hashes `bits` bits, sampled from the octaves by their length. Inside a bucket a search through near members, each verified by the likeness, gives a tree of links, one
    link fewer than members: no pairs are emitted, and members that are near one another end in one group. A bucket with more than `MEMBERS` members is split into blocks
    of pairs of salts, so that each pair meets in one block. Only banding can miss: a pair just at `least` shares no bucket with a probability of about
    (1 - least ** (bits / 4)) ** bands, 2e-3 by default, and a nearer pair with less; it is then still linked if others lie between.
    """
    distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()

    def keys(batches):
        for b in batches:
            fps, out = b.column("fingerprint").to_pylist(), []
            for fp in fps:
                v = unpacked(fp)
                top = len(v)
                each = []
                for back in (0, 1):  # texts whose lengths fall on two sides of a power of two meet in the lower one
                    k = max(1, top - back)
                    octave, sample = _picks(k, bands, bits)
                    picks = v[octave, sample]
                    each += [hashlib.blake2b(picks[i].tobytes() + bytes([k, i]), digest_size=8).digest() for i in range(bands)]
                out.append([int.from_bytes(x, "little", signed=True) for x in dict.fromkeys(each)])
            node = [hashlib.blake2b(fp.encode(), digest_size=16).digest() for fp in fps]
            yield pa.RecordBatch.from_arrays([b.column("fingerprint"), pa.array(node, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["fingerprint", "node", "keys"])

    spark = prints.sparkSession
    with common.scratch(spark) as keep:
        every = common.stored(distinct.mapInArrow(keys, "fingerprint string, node binary, keys array<bigint>"))
        keyed = every.select("node", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        salts = F.ceil(F.col("n") / MEMBERS).cast("int")
        salt = F.pmod(F.xxhash64("node"), salts).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), salts - 1), lambda t: F.least(salt, t).cast("long") * salts + F.greatest(salt, t))
        members = keep(keyed.join(shared, "key").select("key", "node", F.explode(blocks).alias("block")))
        members = members.join(every.select("node", "fingerprint"), "node")
        members = members.repartition(common.partitions(spark), "key", "block").sortWithinPartitions("key", "block")

        def search(batches):
            def links():
                for t in _groups(batches, ("key", "block")):
                    if t.num_rows < 2:
                        continue
                    node, fps = t.column("node").to_pylist(), t.column("fingerprint").to_pylist()
                    values = np.zeros((max(len(fp) for fp in fps) // SAMPLES, len(fps), SAMPLES), np.uint8)
                    for i, fp in enumerate(fps):
                        v = unpacked(fp)
                        values[: len(v), i] = v
                    left = np.arange(len(fps))
                    while len(left) > 1:
                        waiting, left = [left[0]], left[1:]
                        while waiting and len(left):
                            p = waiting.pop()
                            near = likenesses(values[:, p], values[:, left], least)
                            yield from ((min(node[p], node[i]), max(node[p], node[i])) for i in left[near])
                            waiting += left[near].tolist()
                            left = left[~near]

            yield from _pairs_out(links())

        found = common.stored(components(keep(members.mapInArrow(search, "a binary, b binary").distinct())))
    return every.select("node", "fingerprint").join(found, "node", "left").select("fingerprint", F.hex(F.coalesce("label", "node")).alias("near_group"))


@cache
def _picks(k: int, bands: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + k)
    octave = k - 1 - np.minimum(rng.geometric(0.5, (bands, bits // 4)) - 1, k - 1)
    return octave, rng.integers(0, SAMPLES, (bands, bits // 4))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        walk = Walk()
        names = [f.split()[0] for f in schema.split(", ")]
        out: list[list] = [[] for _ in names]
        held = None  # a row waits for the next one's fingerprint
        kind = None

        def batch():
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        def finish(next_print):
            row = held
            for column, v in zip(out, (*row, likeness(row[3], row[4]), likeness(row[3], next_print)), strict=True):
                column.append(v)

        def typed(batches):
            nonlocal kind
            for b in batches:
                kind = b.schema.field("doc_id").type
                yield b

        for doc_id, text, next_id, following in with_next(typed(batches)):
            n = len(text)
            keep = n - n // 3
            donor = following[: n // 3]
            own, edited = walk.pair(text, donor, keep)
            if held is not None:
                finish(own if held_next == (doc_id, text) else walk.fingerprint(held_next[1]))
            held, held_next = (doc_id, n, hashlib.sha256((text[:keep] + donor).encode("utf-8", "replace")).hexdigest(), own, edited), (next_id, following)
            if len(out[0]) >= 2000:
                yield batch()
                out = [[] for _ in names]
        if held is not None:
            finish(walk.fingerprint(held_next[1]))
        if out[0]:
            yield batch()

    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    buckets = max(common.partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    return in_order(docs, buckets).mapInArrow(run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
