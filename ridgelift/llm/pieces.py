"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here, and the tokenizer is rebuilt from it: normaliser (character map, extra white space,
dummy prefix), the metaspace marker, unigram scores or, for a BPE model, merges in the order of the scores, and
byte fallback. Batches are encoded by the library's own threads. Where no piece crosses the start of a run of markers,
texts are cut there and each distinct segment of a task is encoded once; else the text is one segment.

The ids are those of the tokenizers library. Parity is verified, not assumed: every raw text is also
encoded whole by the sentencepiece library with the original model, so normaliser, cut and ids are all held to it; a text that
differs falls back to sentencepiece's ids and says so in its row.

The driver reads the model file from the path given, a parameter, and ships its bytes (refused above `MOST_MODEL_BYTES`).

Nulls: a null text is the empty text, with no ids. Repeated rows get equal results, a null id stays null. An empty table gives
an empty result. A very long text is encoded whole, alone in its batch. Other columns pass through `encode` untouched; one named like those
that it adds (ids, decoded, parity) is refused when it is called.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MOST_MODEL_BYTES = 64 << 20
MARK = "▁"
#: Distinct segments that a task keeps before it starts its table again.
MOST_SEGMENTS = 300_000
#: Segments that are encoded at once, and bytes of text that are cut at once.
AT_ONCE = 4_000
TEXT_AT_ONCE = 1 << 20
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value, raw) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        start = at
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + n]
            at += n
        yield tag >> 3, value, data[start:at]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value, _ in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v, _ in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v, _ in _fields(value):
                m.kind = v if n == 3 else m.kind
                m.byte_fallback = bool(v) if n == 35 else m.byte_fallback
        elif number == 3:
            for n, v, _ in _fields(value):
                m.charsmap = v if n == 2 else m.charsmap
                m.dummy_prefix = bool(v) if n == 3 else m.dummy_prefix
                m.squeeze = bool(v) if n == 4 else m.squeeze
                m.escape = bool(v) if n == 5 else m.escape
    return m


def build(m: Model, whole: bool = True):
    """The tokenizer of a parsed model, over normalised text. whole: decodes whole texts, so drops the dummy prefix."""
    from tokenizers import Tokenizer, decoders, models

    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    unk = next((i for i, (_, _, k) in enumerate(m.pieces) if k == UNKNOWN), None)
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk, m.byte_fallback)
    elif m.kind == BPE:
        merges = []
        for p, s, k in m.pieces:
            if k in (NORMAL, USER):
                own = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
                merges += [(-s, ids[p], ids[a], ids[b], a, b) for a, b in own]
        merges.sort()
        core = models.BPE(ids, [(x[4], x[5]) for x in merges], unk_token=None if unk is None else m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"a model of kind {m.kind} is neither unigram nor BPE")
    t = Tokenizer(core)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if whole and m.dummy_prefix else [])])
    return t


def normalizer(m: Model):
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]  # spaces alone, no tabs or line ends
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def segmentable(m: Model) -> bool:
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in m.pieces if k in (NORMAL, USER))


class Encoder:
    """Encodes texts by their distinct normalised segments; lives for one task."""

    def __init__(self, data: bytes):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # beside other tasks, more threads only wait for each other
        m = parse(data)
        self.tokenizer, self.own = build(m, whole=False), sentencepiece.SentencePieceProcessor(model_proto=data)
        self.norm = normalizer(m)
        self.plain_norm = not m.charsmap and not m.squeeze
        self.dummy, self.escape = m.dummy_prefix, m.escape
        self.cuts = segmentable(m)
        self.is_byte = np.array([k == BYTE for _, _, k in m.pieces])
        self.spelt = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces], pa.binary())
        self.clear()
        words.give_back()  # what building the tokenizer took

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)

    def normalised(self, texts: pa.Array) -> pa.Array:
        if not self.plain_norm:
            return pa.array(map(self.norm.normalize_str, texts.to_pylist()), pa.string())
        if self.dummy:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        return pc.replace_substring(texts, " ", MARK) if self.escape else texts

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of normalised texts, and how many each text has. A segment starts where a run of markers does."""
        texts = pa.concat_arrays([texts])  # offsets from 0
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        if not self.cuts or not len(ends) or not ends[-1]:
            return texts.filter(pc.greater(pc.binary_length(texts), 0)), (size > 0).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]]
        a, b, c = MARK.encode()
        mark = np.flatnonzero(data == a)
        mark = mark[mark + 2 < len(data)]
        mark = mark[(data[mark + 1] == b) & (data[mark + 2] == c)]
        fresh = np.ones(len(mark), bool)
        fresh[1:] = mark[1:] - mark[:-1] != 3
        begins = np.zeros(len(data) + 1, bool)
        begins[mark[fresh]] = True
        begins[(ends - size)[size > 0]] = True
        starts = np.flatnonzero(begins[:-1])
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), texts.buffers()[2])
        return found, np.searchsorted(starts, ends) - np.searchsorted(starts, ends - size)

    def learn(self, fresh: list[str]) -> None:
        flat, sizes = [self.ids], [self.size]
        for at in range(0, len(fresh), AT_ONCE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(fresh[at : at + AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
        self.ids, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.at = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of texts without nulls: all ids in a row, the number of ids of each text, the decoded texts, and parity."""
        return self.held_to_the_model(texts, *self.rebuilt(texts))

    def rebuilt(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text, by the rebuilt tokenizer alone."""
        if len(self.place) > MOST_SEGMENTS:
            self.clear()
        found, per_text = self.segments(self.normalised(texts))
        found = found.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        fresh = [s for s in distinct if s not in self.place]
        if fresh:
            self.learn(fresh)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        code = place[found.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        n = self.size[code]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[code] - ends + n, n) + np.arange(ends[-1])] if len(code) else np.zeros(0, np.int32)
        size = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])])
        return ids, size

    def decoded(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """Texts of ids whose bytes make whole characters, as those of an encoded text do."""
        flat = self.spelt.take(pa.array(ids))
        cuts = np.frombuffer(flat.buffers()[1], np.int32)[np.cumsum(np.concatenate([[0], size]))]
        texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(cuts), flat.buffers()[2])
        return pc.replace_substring_regex(texts, r"\A ", "") if self.dummy else texts

    def held_to_the_model(self, texts: pa.Array, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Compares each raw text's ids with those of the original model; where they differ, the latter stand."""
        raw = self.own.encode(texts.to_pylist(), num_threads=1)
        want = np.fromiter(chain.from_iterable(raw), np.int32)
        want_size = np.fromiter(map(len, raw), np.int64, len(raw))
        if np.array_equal(size, want_size):
            parity = np.ones(len(size), bool)
            parity[np.repeat(np.arange(len(size)), size)[ids != want]] = False
            ids = ids if parity.all() else np.where(np.repeat(parity, size), ids, want)
        else:
            own, theirs = (np.split(x, np.cumsum(n)[:-1]) for x, n in ((ids, size), (want, want_size)))
            parity = np.array([np.array_equal(x, y) for x, y in zip(own, theirs, strict=True)], bool)
            ids = np.concatenate([x if ok else y for x, y, ok in zip(own, theirs, parity, strict=True)])
            size = np.where(parity, size, want_size)
        decoded = self.decoded(ids, size)
        if not parity.all():
            texts_of = [d.decode() if ok else self.tokenizer.decode(w, skip_special_tokens=False).removeprefix(" " if self.dummy else "") for d, ok, w in zip(decoded.cast(pa.binary()).to_pylist(), parity, raw, strict=True)]
            decoded = pa.array(texts_of, pa.string())
        return ids, size, decoded, parity


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; executors get the bytes
        data = f.read(MOST_MODEL_BYTES + 1)
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MOST_MODEL_BYTES} bytes")
    return data


def encode(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """docs with ids (array<int>), decoded (text), parity (boolean)."""
    data = model_bytes(path)
    common.no_clash(docs, "ids", "decoded", "parity")
    place = docs.columns.index("text")

    def run(batches):
        encoder = Encoder(data)
        for b in words.slices(batches, at_most=TEXT_AT_ONCE):
            ids, size, decoded, parity = encoder.encode(b.column("text"))
            array = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, array, decoded, pa.array(parity, pa.bool_())], [*b.schema.names, "ids", "decoded", "parity"])
        del encoder
        words.give_back()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    fields[place] = "`text` string"
    return docs.mapInArrow(run, ", ".join([*fields, "ids array<int>", "decoded string", "parity boolean"]))


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """encoded (with ids) with text, decoded from the ids; null ids give null."""
    data = model_bytes(path)
    base = encoded.drop("text")

    def run(batches):
        tokenizer = build(parse(data))
        for b in batches:
            texts = [None if i is None else tokenizer.decode(i, skip_special_tokens=False) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    return base.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "text string"]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids: their number, SHA-256 of the ids as little-endian 32-bit numbers, ids that stand for bytes, round trip and parity."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    data = model_bytes(MODEL_PATH)

    def run(batches):
        encoder = Encoder(data)
        for b in words.slices(batches, at_most=TEXT_AT_ONCE):
            texts = b.column("text")
            ids, size, decoded, parity = encoder.encode(texts)
            ends = np.cumsum(size)
            raw, bytes_before = ids.astype("<i4"), np.concatenate([[0], np.cumsum(encoder.is_byte[ids])])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array([hashlib.sha256(raw[e - n : e].tobytes()).hexdigest() for e, n in zip(ends, size, strict=True)], pa.string()),
                    pa.array(bytes_before[ends] - bytes_before[ends - size], pa.int64()),
                    pc.equal(decoded, pc.replace_substring(texts, MARK, " ")),
                    pa.array(parity, pa.bool_()),
                ],
                ["doc_id", "n_ids", "ids_sha256", "n_byte_ids", "round_trip", "parity"],
            )
        del encoder
        words.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_ids bigint, ids_sha256 string, n_byte_ids bigint, round_trip boolean, parity boolean")
