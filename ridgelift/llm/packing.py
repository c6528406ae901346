"""Packing token ids of documents into sequences of a fixed size, by first-fit decreasing in randomised groups.

Documents are encoded (`WordIds`), each followed by an end id, and written with their ids. A hash of id and ids deals them into groups of
about `GROUP_TOKENS` tokens. In a group every document gives its full sequences first; what is left of it is a piece. Pieces go, largest first,
into the first sequence with room: a tournament tree over the free tokens of all sequences finds it in a logarithm of steps. The gaps
that remain are filled by cutting pieces of the last sequences, and the one sequence that is then still open is cut into powers of two,
which need no padding. So no sequence is padded, and about one document a sequence is cut.

Encoding: a text is cut at white space and where ASCII letters, digits and signs meet, wherever the tokenizer cuts it too; each distinct part is encoded
once by a Python worker. That holds for the pre-tokenizer named in `CUTTABLE`; with any other, and for texts that hold a special token, the library encodes whole texts.

The driver reads the tokenizer's file from the path given, a parameter, and ships its bytes (refused above `MOST_BYTES`).

Nulls: a null text is the empty text, with the end id alone; a null id stays null. Very long texts are packed whole. Ties of lengths go by the hash. Repeated rows
(same id and text) are packed each for itself, and count up in their task to fall into different groups. An empty table gives an empty result. Other columns are not
read, so their names cannot clash. Reruns agree where no row repeats, and else over the same partitions.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

TOKENIZER_PATH = "/opt/tokenizers/word_bpe_49k.json"
MOST_BYTES = 64 << 20
SIZE = 2048
END = 1
GROUP_TOKENS = 1 << 20
SEED = "pack-1"
TEXT_AT_ONCE = 4 << 20
#: Distinct parts of texts that a worker keeps before it starts its table again, and that are encoded as one text.
MOST_PARTS = 800_000
TOGETHER = 1_000
#: Pieces' ids that a group hands out at once.
OUT_AT_ONCE = 4 << 20
#: The pre-tokenizer whose cuts `WordIds` knows. Fixed values of the tokenizer's file.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

SIGN, LETTER, DIGIT, SPACE, WIDE, QUOTE = range(6)


def _kinds() -> bytes:
    kind = np.full(256, SIGN, np.uint8)
    kind[ord("a") : ord("z") + 1] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[128:] = WIDE
    kind[ord("'")] = QUOTE
    return kind.tobytes()


def _cuts() -> np.ndarray:
    """[left, right]: whether a text may be cut between bytes of these kinds. Contractions and other characters than ASCII stay with their neighbours."""
    cut = ~np.eye(6, dtype=bool)
    cut[WIDE, :] = cut[:, WIDE] = False
    cut[SIGN, QUOTE] = cut[QUOTE, SIGN] = cut[QUOTE, LETTER] = False
    cut[DIGIT, DIGIT] = cut[SPACE, :] = cut[:, SPACE] = True  # a run of white space is one part, left out
    return cut


KINDS, CUTS = _kinds(), _cuts()


class WordIds:
    """Encodes texts by their distinct parts, which it keeps; `word_ids` has one for all tasks of a Python worker. encode: all ids in a row, and the number of ids of each text."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks beside this one use the other cores
        self.tokenizer, said, endings = _tokenizer(data)
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])] == NORMALIZERS
        self.cuttable = known and steps[0].get("pattern", {}).get("Regex") == CUTTABLE and bool(said["model"].get("end_of_word_suffix")) and not said["post_processor"]
        self.special = [x["content"] for x in said["added_tokens"]]
        self.endings = endings
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, self.dtype)
        self.size = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fresh: list[str]) -> None:
        """Ids of parts that are new: plain ones many at once, told apart by the ids that end a word; those with quotes or other characters alone."""
        plain = [p for p in fresh if p.isascii() and "'" not in p]
        mixed = [p for p in fresh if not p.isascii() or "'" in p]
        ids, size = [], []
        for at in range(0, len(plain), TOGETHER):
            own = plain[at : at + TOGETHER]
            found = np.array(self.library([" ".join(own)])[0], self.dtype)
            ends = np.flatnonzero(self.endings[found]) + 1
            if len(ends) == len(own) and ends[-1] == len(found):
                ids.append(found)
                size.append(np.diff(ends, prepend=0))
            else:
                mixed, plain = own + mixed, plain[:at] + [None] * len(own) + plain[at + TOGETHER :]
        if mixed:
            alone = self.library(mixed)
            ids.append(np.fromiter(chain.from_iterable(alone), self.dtype))
            size.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        parts = [p for p in plain if p is not None] + mixed
        self.place.update(zip(parts, range(len(self.place), len(self.place) + len(parts)), strict=True))
        self.ids, self.size = np.concatenate([self.ids, *ids]), np.concatenate([self.size, *size])
        self.at = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = functools.reduce(pc.or_, (pc.match_substring(texts, s) for s in self.special), pa.array(np.zeros(len(texts), bool)))
        if not self.cuttable or pc.any(whole).as_py():
            found = self.library(texts.to_pylist())
            return np.fromiter(chain.from_iterable(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found))
        return self.by_parts(pa.concat_arrays([pc.ascii_lower(texts)]))  # offsets from 0

    def by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(ends) or not ends[-1]:
            return np.zeros(0, self.dtype), np.zeros(len(ends), np.int64)
        if len(self.place) > MOST_PARTS:
            self.clear()
        kind = np.frombuffer(texts.buffers()[2][: ends[-1]].to_pybytes().translate(KINDS), np.uint8)
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        begins = np.zeros(len(kind), bool)
        begins[change[CUTS[kind[change - 1], kind[change]]]] = True
        begins[0] = begins[ends[ends < len(kind)]] = True
        starts = np.flatnonzero(begins)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(kind)).astype(np.int32)), texts.buffers()[2])
        full = kind[starts] != SPACE
        starts, parts = starts[full], parts.filter(pa.array(full)).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        place = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [distinct[i] for i in new.tolist()]
            self.learn(fresh)
            place[new] = np.fromiter(map(self.place.__getitem__, fresh), np.int64, len(fresh))
        code = place[parts.indices.to_numpy(zero_copy_only=False)]
        n = self.size[code]
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[code] - upto + n, n) + np.arange(n.sum())]
        return ids, np.diff(np.concatenate([[0], upto])[np.concatenate([[0], np.searchsorted(starts, ends)])])


def _tokenizer(data: bytes):
    """The tokenizer, its file, and which ids end a word."""
    from tokenizers import Tokenizer

    said = json.loads(data)
    t, suffix = Tokenizer.from_str(data.decode()), said["model"].get("end_of_word_suffix")
    endings = np.zeros(t.get_vocab_size(), bool)
    if suffix:
        endings[[i for token, i in t.get_vocab().items() if token.endswith(suffix)]] = True
    return t, said, endings


@functools.lru_cache(maxsize=1)
def word_ids(data: bytes) -> WordIds:
    return WordIds(data)


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; executors get the bytes
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return data


def encode(docs: DataFrame, path: str = TOKENIZER_PATH, end: int = END) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n (ids, the end id included), width (bytes of an id), ids (binary, little-endian), draw (long): what deals documents into groups."""
    data = tokenizer_bytes(path)

    def run(batches):
        words_of = word_ids(data)
        seen: Counter = Counter()
        for b in words.slices(batches, at_most=TEXT_AT_ONCE):
            ids, size = words_of.encode(b.column("text"))
            ends = np.cumsum(size)
            ids = np.insert(ids, ends, words_of.dtype.type(end))
            ends = np.cumsum(size + 1)
            raw = [ids[e - n : e].tobytes() for e, n in zip(ends, size + 1, strict=True)]
            draws = []
            for doc_id, own in zip(b.column("doc_id").to_pylist(), raw, strict=True):
                key = xxhash.xxh3_64_intdigest(f"{SEED}:{'' if doc_id is None else doc_id}:".encode() + own)
                seen[key] += 1
                draws.append((key if seen[key] == 1 else xxhash.xxh3_64_intdigest(f"{key}:{seen[key]}")) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size + 1, pa.int64()), pa.array(np.full(len(size), words_of.dtype.itemsize), pa.int32()), pa.array(raw, pa.binary()), pa.array(draws, pa.int64())],
                ["doc_id", "n", "width", "ids", "draw"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, width int, ids binary, draw bigint")


class Tournament:
    """Free tokens of a row of sequences, as a tree whose inner nodes hold the larger of their two."""

    def __init__(self, n: int, size: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.free = [size] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first sequence with room for need."""
        at = 1
        while at < self.leaves:
            at *= 2
            at += self.free[at] < need
        return at - self.leaves

    def take(self, place: int, need: int) -> None:
        at = place + self.leaves
        self.free[at] -= need
        while at > 1:
            at //= 2
            most = max(self.free[2 * at], self.free[2 * at + 1])
            if self.free[at] == most:
                break
            self.free[at] = most


Piece = tuple[int, int, int]  # the document's place in its group, start, length


def first_fit(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """pieces: largest first, none above size. Sequences in the order they were opened: all but one are at least half full."""
    tree = Tournament(2 * sum(p[2] for p in pieces) // size + 1, size)
    out: list[list[Piece]] = []
    for p in pieces:
        place = tree.first(p[2])
        tree.take(place, p[2])
        if place == len(out):
            out.append([])
        out[place].append(p)
    return out


def without_gaps(rows: list[list[Piece]], size: int) -> list[list[Piece]]:
    """Cuts pieces of the last sequences to fill the gaps of the first, until at most one has room; that one becomes powers of two."""
    front = 0
    free = [size - sum(p[2] for p in row) for row in rows]
    while front < len(rows) - 1:
        if not free[front]:
            front += 1
        elif not rows[-1]:
            rows.pop()
        else:
            doc, start, n = rows[-1].pop()
            fits = min(n, free[front])
            rows[front].append((doc, start, fits))
            free[front] -= fits
            if fits < n:
                rows[-1].append((doc, start + fits, n - fits))
    left = rows.pop() if rows else []
    held = sum(p[2] for p in left)
    left.reverse()
    for want in [held] if held == size else [1 << k for k in range(held.bit_length() - 1, -1, -1) if held >> k & 1]:
        row: list[Piece] = []
        while want:
            doc, start, n = left.pop()
            fits = min(n, want)
            row.append((doc, start, fits))
            want -= fits
            if fits < n:
                left.append((doc, start + fits, n - fits))
        rows.append(row)
    return rows


def packed(lengths: list[int], size: int) -> list[list[Piece]]:
    """The sequences of one group, from the lengths of its documents."""
    full = [[(doc, start, size)] for doc, n in enumerate(lengths) for start in range(0, n - size + 1, size)]
    rest = [(doc, n - n % size, n % size) for doc, n in enumerate(lengths) if n % size]
    return full + without_gaps(first_fit(sorted(rest, key=lambda p: -p[2]), size), size)


def pack(docs: DataFrame, size: int = SIZE, path: str = TOKENIZER_PATH, end: int = END, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """docs: doc_id, text. Returns the pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    kept = common.stored(encode(docs, path, end))
    total = kept.agg(F.sum("n")).head()[0] or 0
    groups = -(-total // group_tokens) or 1

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("draw")
        ids, tokens, docs_of = table.column("ids"), table.column("n").to_numpy(), table.column("doc_id")
        kind = np.dtype(f"<u{table.column('width')[0].as_py()}")
        flat: list[tuple[int, int, int, int, int]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            doc, start, n, row, offset = (np.array(x, np.int64) for x in zip(*flat, strict=True))
            own: dict[int, np.ndarray] = {}
            raw = []
            for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True):
                if d not in own:
                    own[d] = np.frombuffer(ids[d].as_buffer(), kind)
                raw.append(own[d][s : s + m].astype("<u4").tobytes())
            columns = [docs_of.take(pa.array(doc)).combine_chunks(), pa.array(start), pa.array(n), pa.array(raw, pa.binary()), pa.array(tokens[doc]), pa.array((key[0].as_py() << 32) + row), pa.array(offset)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for row, pieces in enumerate(packed(tokens.tolist(), size)):
            offset = 0
            for doc, start, n in pieces:
                flat.append((doc, start, n, row, offset))
                offset += n
            held += offset
            if held >= OUT_AT_ONCE:
                yield batch()
                flat, held = [], 0
        if flat:
            yield batch()

    kind = kept.schema["doc_id"].dataType.simpleString()
    dealt = kept.withColumn("group", F.pmod(F.xxhash64("draw"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
