"""Words of Arrow batches as integer codes: what the tasks of several operators start from."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", at_most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about at_most bytes of text, or one text; null texts become empty."""
    for b in batches:
        place = b.schema.get_field_index(text)
        b = b.set_column(place, text, pc.fill_null(b.column(text), ""))
        ends = np.cumsum(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_most, side="right")))
            yield b.slice(at, to - at)
            at = to


def give_back() -> None:
    """Returns freed memory to the system: a worker that Spark keeps for later tasks else stays as large as its largest task was."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cases A-Z and splits on ASCII white space: (code of each word, number of words of each text, the distinct words)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at either end leaves empty words
    if not full.all():
        row = np.repeat(np.arange(len(n)), n)
        n = np.bincount(row[full], minlength=len(n))
        flat = flat.filter(pa.array(full))
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), n, d.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; with fewer words, of the whole sequence; none without words."""
    codes, counts, words = word_codes(texts)
    w = hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.full(max(0, len(w) - n + 1), np.uint64(n))
    for i in range(n):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(rolled)])
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(rolled[at : at + c - n + 1]))
        elif c:
            h = np.full(1, np.uint64(c))
            for i in range(c):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[at + i])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
