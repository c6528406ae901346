"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put into another order behind sentinels.

A text is one bytearray from cut to output. Its line ends are scanned, two cuts at ends of lines are drawn from the id, and the three
sentinels are inserted before their segments, last first. Two neighbouring blocks then change places by a rotation made of three reversals, each done in
place through a buffer of `SWAP` bytes: the suffix goes before the middle (psm) or before both others (spm). To restore a text, the sentinels
are found in the output, the rotation is inverted and the sentinels are taken out. A text that holds a sentinel of its own stays plain, so each is found once:
sentinels do not overlap themselves, and a segment of a text without them holds none.

Bytes are as good as characters here: a line feed is one byte that is part of no other character, and cuts lie at ends of lines only.

Nulls: a null text is the empty text, which stays plain; a null id draws as the empty text does. Very long texts are treated whole, alone in
their batch. Ties of the two draws give an empty middle. Repeated rows (same id and text) get equal results, and an empty table an empty one. Other columns pass
through untouched; those named like a column that is added are refused when the operator is called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Of 100 texts so many are cut, and of those so many have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SWAP = 1 << 16
TEXT_AT_ONCE = 4 << 20


def reverse(a: np.ndarray) -> None:
    """Reverses bytes in place, a block from either end at a time."""
    lo, hi = 0, len(a)
    while hi - lo > 1:
        n = min(SWAP, (hi - lo) // 2)
        head = a[lo : lo + n].copy()
        a[lo : lo + n] = a[hi - n : hi][::-1]
        a[hi - n : hi] = head[::-1]
        lo, hi = lo + n, hi - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges the blocks [start, cut) and [cut, end) in place, by three reversals."""
    a = np.frombuffer(buffer, np.uint8)
    reverse(a[start:cut])
    reverse(a[cut:end])
    reverse(a[start:end])


def units(data: bytes | bytearray) -> np.ndarray:
    """Where each line ends, in bytes; the last one may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not len(data) or len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i : i + 8], 16) for i in range(0, 32, 8)]


def characters(data: memoryview) -> int:
    """Code points of UTF-8: bytes that continue none."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def transformed(text: str, doc_id: object, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple[bytearray, str, int, int | None, int | None]:
    """The output's bytes, the form, the number of lines, and the code points of prefix and middle."""
    buffer = bytearray(text.encode())
    ends = units(buffer)
    n = len(ends)
    first, second, third, fourth = draws(doc_id, seed)
    if not buffer or third % 100 >= rate or any(s in buffer for s in (PREFIX, SUFFIX, MIDDLE)):
        return buffer, "plain", n, None, None
    low, high = sorted((first % (n + 1), second % (n + 1)))
    low, high = (int(ends[k - 1]) if k else 0 for k in (low, high))
    view = memoryview(buffer)
    chars = characters(view[:low]), characters(view[low:high])
    view.release()
    for at, sentinel in ((high, SUFFIX), (low, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = low + len(PREFIX), high + len(PREFIX) + len(MIDDLE)
    form = "spm" if fourth % 100 < suffix_first else "psm"
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return buffer, form, n, *chars


def restored(output: str, form: str) -> bytearray:
    """The text again, from output and form alone."""
    buffer = bytearray(output.encode())
    if form == "plain":
        return buffer
    prefix, suffix, middle = (buffer.index(s) for s in (PREFIX, SUFFIX, MIDDLE))
    if form == "spm":
        rotate(buffer, 0, prefix, len(buffer))
        suffix = len(buffer) - prefix
        middle -= prefix
    elif form == "psm":
        rotate(buffer, suffix, middle, len(buffer))
        middle, suffix = suffix, suffix + len(buffer) - middle
    else:
        raise ValueError(f"{form} is no form: plain, psm or spm")
    for at, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(sentinel)]
    return buffer


def _columns(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, ...) with output, form (plain, psm, spm), n, prefix_chars, middle_chars (null if plain)."""
    common.no_clash(docs, "output", "form", "n", "prefix_chars", "middle_chars")

    def run(batches):
        for b in words.slices(batches, at_most=TEXT_AT_ONCE):
            made = [transformed(t, i, rate, suffix_first, seed) for t, i in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True)]
            output, form, n, prefix, middle = zip(*made, strict=True)
            added = [pa.array([str(o, "utf-8") for o in output], pa.string()), pa.array(form, pa.string()), pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, "output", "form", "n", "prefix_chars", "middle_chars"])

    return docs.mapInArrow(run, ", ".join([*_columns(docs), "output string, form string, n bigint, prefix_chars bigint, middle_chars bigint"]))


def restore(outputs: DataFrame) -> DataFrame:
    """outputs (output, form, ...) with restored: the texts that they were made from."""
    common.no_clash(outputs, "restored")

    def run(batches):
        for b in words.slices(batches, "output", TEXT_AT_ONCE):
            texts = [str(restored(o, f), "utf-8") for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "restored"])

    return outputs.mapInArrow(run, ", ".join([*_columns(outputs), "restored string"]))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(transform(docs).drop("text")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
x as (select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from x),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:], ''), '') as suffix from c)
select doc_id, n::bigint as n, form, case when form != 'plain' then length(prefix)::bigint end as prefix_chars, case when form != 'plain' then length(middle)::bigint end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
 sha256(text) as restored_sha256 from p
"""
