"""MinHash near-dedup with odd sketches.

Documents with equal shingle sets form one class; the rest is done with one member of each class. A class gets k MinHash
values. Bands of them propose candidates: the number of bands follows from the threshold, so that a pair at the threshold
is missed with a probability of at most `MISS`. The same k values, folded into a bitmap by parity, are the odd sketch: the
population count of two sketches' XOR estimates the similarity, precisely for similar sets, and drops candidates that
lie `SIGMAS` standard deviations below the threshold. What is left is confirmed on full sets.

Inside a bucket no task emits all pairs: a search through the members with near sketches gives a tree of candidate links, one link
fewer than members. Trees join into families, which can only be larger than the true groups. Each family's full sets are
gathered, and a search through them by exact similarity gives the groups: nothing is emitted but a label per member. A bucket
with more than `BLOCK` members is split into blocks of pairs of salts, so that each pair meets in one block. So is a family, by its members
and by the hashes in their sets (`FAMILY`, `FAMILY_HASHES` for each salt); the labels found in its blocks are links, and join into the family's groups.
Shingles are told apart by 64-bit hashes, in the confirmation too.

Nulls: a null text, an empty one and one without words have the empty set and are linked with nothing: a component of their own,
kept. Null ids: such a row joins components by its text, and the component's id is its smallest non-null id, or null if
there is none; kept compares null-safely. Repeated rows fall in the same class: rows with the component's id are all kept. An empty
table gives an empty result. A very long text is one set, however large. Other columns, whatever their names, pass through `keep_one` untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .components import components

ROWS = 5  # MinHash values in a band
MISS = 1e-7
SIGMAS = 5
BITS = 1024
#: Bytes of text that a task holds as hashes at once.
TEXT_AT_ONCE = 1 << 20
BLOCK = 20_000
FAMILY = 10_000
#: Shingle hashes of a salt of a family: 8 bytes each, and about 70 with the copies that resolve them; two salts meet in a block.
FAMILY_HASHES = 750_000
SEED = 1_618_033


class Scheme:
    """The parameters that follow from the threshold (per cent)."""

    def __init__(self, percent: int, shingle: int):
        t = percent / 100
        self.percent, self.shingle = percent, shingle
        self.bands = math.ceil(math.log(MISS) / math.log(1 - t**ROWS))
        self.k = self.bands * ROWS
        cut = t - SIGMAS * math.sqrt(t * (1 - t) / self.k)
        # of 2k(1-J) parities that differ, so many bits stay set after collisions
        self.most_bits = math.floor(BITS / 2 * (1 - math.exp(-4 * self.k * (1 - cut) / BITS)))
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 2**31, self.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, self.k, dtype=np.uint32)

    def minhash(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, k) smallest hash values; no set may be empty."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        return np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(self.a, self.b, strict=True)], 1)

    def keys(self, mins: np.ndarray) -> np.ndarray:
        h = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), (len(mins), self.bands))
        for r in range(ROWS):
            h = words.mix64(h * np.uint64(0x9E3779B97F4A7C15) + mins[:, r :: ROWS].astype(np.uint64) + np.uint64(1))
        return h.view(np.int64)

    def sketches(self, mins: np.ndarray) -> np.ndarray:
        at = words.mix64(mins.astype(np.uint64) << np.uint64(10) | np.arange(self.k, dtype=np.uint64)) % np.uint64(BITS)
        odd = np.zeros((len(mins), BITS), np.uint8)
        np.add.at(odd, (np.arange(len(mins))[:, None], at.astype(np.int64)), 1)
        return np.packbits(odd & 1, axis=1)


def prints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """_id, _th, n_shingles, node (digest of the shingle set, null if empty), keys (of its bands), sketch."""

    def run(batches):
        for b in words.slices(batches, at_most=TEXT_AT_ONCE):
            sets = words.shingle_sets(b.column("text"), scheme.shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            node: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                mins = scheme.minhash([sets[i] for i in full])
                for i, k, s in zip(full, scheme.keys(mins), scheme.sketches(mins), strict=True):
                    node[i], keys[i], sketch[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k, s.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["_id", "_th", "n_shingles", "node", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*common.row_key(), "text").mapInArrow(run, f"_id {kind}, _th bigint, n_shingles bigint, node binary, keys array<bigint>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that are sorted by some columns, as one table a group."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        changes = np.zeros(n - 1, bool)
        for c in by:
            changes |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
        for at, to in zip(cuts, cuts[1:], strict=False):
            now = tuple(b.column(c)[at].as_py() for c in by) if at == 0 else None
            if held and (at > 0 or now != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, to - at))
        last = tuple(b.column(c)[n - 1].as_py() for c in by)
    if held:
        yield pa.Table.from_batches(held)


def _bits(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)


def _pairs_out(pairs: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    a: list[bytes] = []
    b: list[bytes] = []
    for x, y in pairs:
        a.append(x)
        b.append(y)
        if len(a) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _trees(most: int):
    """A tree of links through each set of members whose sketches are near, directly or by way of others."""

    def run(batches):
        def pairs():
            for t in _groups(batches, ("key", "block")):
                if t.num_rows < 2:
                    continue
                node, s = t.column("node").to_pylist(), _bits(t)
                left = np.arange(len(s))
                while len(left) > 1:
                    waiting, left = [left[0]], left[1:]
                    while waiting and len(left):
                        p = waiting.pop()
                        near = np.bitwise_count(s[left] ^ s[p]).sum(1) <= most
                        yield from ((node[p], node[i]) for i in left[near])
                        waiting += left[near].tolist()
                        left = left[~near]

        yield from _pairs_out(pairs())

    return run


def _distinct_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family, block and node, repeated nodes (of repeated rows) left out."""
    last = None
    for b in batches:
        nodes = list(zip(b.column("block").to_pylist(), b.column("node").to_pylist(), strict=True))
        keep = [x != y for x, y in zip(nodes, [last, *nodes[:-1]], strict=True)] if nodes else []
        last = nodes[-1] if nodes else last
        yield b.filter(pa.array(keep, pa.bool_()))


def _groups_of_families(percent: int):
    """Of the full sets of each family's block, the label (smallest node) of each member's group, by exact similarity; `whole` if the family has no other block."""

    def run(batches):
        for t in _groups(_distinct_nodes(batches), ("family", "block")):
            t = t.sort_by("node")
            node = t.column("node").to_pylist()
            sets = [np.frombuffer(m, np.uint64) for m in t.column("members").to_pylist()]
            size = np.array([len(s) for s in sets])
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            own = np.split(flat, np.cumsum(size)[:-1])
            label: list = [None] * len(node)
            mark = np.zeros(flat.max() + 1, np.int32)
            left = np.arange(len(node))
            while len(left):
                first = left[0]
                waiting, fresh = [first], np.zeros(len(left), bool)
                fresh[0] = True
                while True:  # left and flat hold what no group has taken yet
                    for i in left[fresh]:
                        label[i] = node[first]
                    flat, left = flat[~np.repeat(fresh, size[left])], left[~fresh]
                    if not waiting or not len(left):
                        break
                    p = waiting.pop()
                    mark[own[p]] = 1
                    both = np.add.reduceat(mark[flat], np.cumsum(size[left]) - size[left])
                    mark[own[p]] = 0
                    fresh = 100 * both >= percent * (size[left] + size[p] - both)
                    waiting += left[fresh].tolist()
            whole = pa.array([t.column("salts")[0].as_py() == 1] * len(node), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(label, pa.binary()), whole], ["node", "label", "whole"])

    return run


def full_sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """nodes with `members`, the full set as packed hashes. Only texts of these nodes are gathered."""
    wanted = common.stored(nodes.join(reps.select("node", "_id", "_th"), "node"))
    kept = [c for c in nodes.columns if c != "node"]
    texts = docs.select(*common.row_key(), "text")
    # sorted and merged whatever the size of wanted: it grows with the corpus, and so the plan is the same at every scale
    texts = texts.join(wanted.hint("merge"), common.same_key(texts, wanted)).select("node", *kept, "text")

    def sets(batches):
        for b in words.slices(batches, at_most=TEXT_AT_ONCE):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", *kept)), pa.array([s.tobytes() for s in words.shingle_sets(b.column("text"), scheme.shingle)], pa.binary())], ["node", *kept, "members"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select("node", *kept).schema)
    return texts.mapInArrow(sets, f"{fields}, members binary")


def classes(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """One row per row of docs: _id, _th, n_shingles, component (smallest non-null id reachable), label (of the component; null for the empty set)."""
    scheme = Scheme(percent, shingle)
    p = common.stored(prints(docs, scheme))
    first = F.min_by(F.struct("_id", "_th", "keys", "sketch", "n_shingles"), F.struct(F.col("_id").isNull(), "_id", "_th"))
    reps = common.stored(p.where("node is not null").groupBy("node").agg(F.min("_id").alias("least"), first.alias("r")).select("node", "least", "r.*"))

    keyed = reps.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    salt = F.pmod(F.xxhash64("node"), salts).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), salts - 1), lambda t: (F.least(salt, t) * salts + F.greatest(salt, t)).cast("int"))
    members = keyed.join(shared, "key").select("key", "node", F.explode(blocks).alias("block"))
    members = common.stored(members.join(reps.select("node", "sketch"), "node"))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(common.partitions(df.sparkSession), "key", "block").sortWithinPartitions("key", "block")

    links = common.stored(by_bucket(members).mapInArrow(_trees(scheme.most_bits), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    families = components(links).withColumnRenamed("label", "family")
    sizes = families.join(reps.select("node", "n_shingles"), "node").groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes"))
    sizes = sizes.select("family", F.ceil(F.greatest(F.col("n") / FAMILY, F.col("hashes") / FAMILY_HASHES)).cast("int").alias("salts"))
    own = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda t: F.least(own, t).cast("long") * F.col("salts") + F.greatest(own, t))
    dealt = families.join(sizes, "family").select("node", "family", "salts", F.explode(pairs).alias("block"))
    of_family = full_sets(dealt, reps, docs, scheme)
    of_family = of_family.repartition(common.partitions(docs.sparkSession), "family", "block").sortWithinPartitions("family", "block", "node")
    # one function a stage: each further one is one more Python worker beside every task, and workers stay
    resolved = common.stored(of_family.mapInArrow(_groups_of_families(percent), "node binary, label binary, whole boolean"))
    found = resolved.where("whole").select("node", "label")
    joins = resolved.where("not whole and node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    if joins.head(1):
        found = found.unionByName(components(joins))

    label = common.stored(reps.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")))
    smallest = label.groupBy("label").agg(F.min("least").alias("component"))
    of_node = label.join(smallest, "label").select(F.col("node").alias("_node"), "component", "label")
    return p.join(of_node, p["node"] == of_node["_node"], "left").select("_id", "_th", "n_shingles", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component")).alias("component"), "label")


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """docs with one row of each group, the one with the component's id; rows with the empty set all stay."""
    every = classes(docs, percent, shingle).where(F.col("label").isNull() | F.col("_id").eqNullSafe(F.col("component")))
    one = every.where("label is not null").groupBy("label").agg(F.min(F.struct("_id", "_th")).alias("r")).select("r._id", "r._th", "label")
    chosen = one.unionByName(every.where("label is null").select("_id", "_th", "label").distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("row_id"), F.xxhash64(common.text_or_empty(F.col("text"))).alias("row_th"))
    kept = keyed.join(chosen, F.col("row_id").eqNullSafe(F.col("_id")) & (F.col("row_th") == F.col("_th")))
    repeated = kept.where("label is not null").dropDuplicates(["label"])  # only rows with equal id and text are left to choose from
    return repeated.unionByName(kept.where("label is null")).select("row.*")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, percent=85, shingle=3).select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept"))


OP9_SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from t),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
      having 100 * count(*) >= 85 * ((select n from n where n.doc_id = a.doc_id) + (select n from n where n.doc_id = b.doc_id) - count(*))),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as node, doc_id as lead from t union select r.node, u.b from r join u on r.lead = u.a),
c as (select node, min(lead) as component_id from r group by node)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, t.doc_id = c.component_id as kept
from t left join n using (doc_id) join c on c.node = t.doc_id
"""
