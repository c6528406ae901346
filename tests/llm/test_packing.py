import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ridgelift.llm import packing

from .helpers import docs, tables

SF = "/root/testdata/sf0.01"
AWKWARD = [
    "", " ", "\n\t", "Don't 'tis it's ''s .'s 'S 're're", "a.b,c;d 12345 3.14 x2y 5é é5", "naïve café café ́x á", "İstanbul ΣΑΣ straße ﬁ Å", "日本語 テキスト　全角", " nbsp em\u0085nel",
    "<|endoftext|> and <|startoftext|>x", "<|ENDOFTEXT|>", "\x00\x01\x1f\x7f", "👩‍👩‍👧 emoji 🇩🇪", "5⃣ 1́ .́", "'́ x'́y", "''''", "it'S I'LL we'Ve", "_under_ -- ... ?!'?", "x" * 30_000, "word " * 30_000, "각 한글",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.TOKENIZER_PATH)


def test_ids_are_those_of_the_library(spark, library):
    texts = AWKWARD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(2)
    signs = list("aZs '.,-5\té́\n\"<|>tLλ ")
    texts += ["".join(rng.choice(signs, int(n))) for n in rng.integers(0, 40, 3000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    own = packing.WordIds(packing.tokenizer_bytes(packing.TOKENIZER_PATH))
    assert own.cuttable
    for at in range(0, len(texts), 97):
        ids, size = own.encode(pa.array(texts[at : at + 97]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want[at : at + 97]
    odd = [t for t in texts if "<|" in t][:50]
    ids, size = own.encode(pa.array(odd))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_table_starts_again(monkeypatch, library):
    monkeypatch.setattr(packing, "MOST_PARTS", 3)
    monkeypatch.setattr(packing, "TOGETHER", 2)
    own = packing.WordIds(packing.tokenizer_bytes(packing.TOKENIZER_PATH))
    for t in ("one two three four five", "six one two", "", "seven eight, nine"):
        assert own.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def held(pieces, size=2048):
    """Checks sequences and pieces, gives tokens by document and padding."""
    by_doc, by_row = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_row.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for row in by_row.values():
        at = 0
        for p in sorted(row, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return by_doc, by_row, padding


def test_every_id_in_one_piece(spark, tmp_path, library):
    rows = list(enumerate([*AWKWARD, None]))
    path = tables(spark, tmp_path, documents=docs(spark, rows).withColumnRenamed("lang", "length"))
    by_doc, by_row, padding = held(packing.op12_packing(spark, path).collect())
    assert len(by_doc) == len(rows) and padding == 0
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist() and sum(p["length"] for p in own) == len(ids)
        for p in own:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())


def test_whole_table(spark):
    pieces = packing.op12_packing(spark, SF).collect()
    by_doc, by_row, padding = held(pieces)
    total = sum(p["length"] for p in pieces)
    assert padding == 0 and len(by_row) <= total // 2048 + 12 and len(by_doc) == 1000
    whole = sum(len(p) == -(-p[0]["doc_tokens"] // 2048) for p in by_doc.values())
    assert whole > 0.9 * len(by_doc)  # not cut more than their length needs
    again = packing.pack(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), group_tokens=100_000)
    other = packing.pack(spark.read.parquet(f"{SF}/documents.parquet").repartition(3), group_tokens=100_000)
    rows = [sorted((r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in x.drop("ids").collect()) for x in (again, other)]
    assert rows[0] == rows[1] and len({r[3] >> 32 for r in rows[0]}) > 5


def test_repeated_rows_nulls_and_nothing(spark):
    rows = [(7, "the same row again")] * 3000 + [(None, "no id")] * 5 + [(8, None)]
    made = packing.pack(docs(spark, rows).coalesce(1), group_tokens=2_000).collect()
    got = Counter()
    for p in made:
        got[p["doc_id"]] += p["length"]
    n = len(np.frombuffer(next(p["ids"] for p in made if p["doc_id"] == 7 and p["start"] == 0), "<u4"))
    assert n >= 1 and got[8] == 1 and got[7] % 3000 == 0
    groups = Counter(p["sequence_id"] >> 32 for p in made)
    assert max(groups.values()) < 0.5 * len(made)  # a hot row falls into many groups
    assert packing.pack(docs(spark, [])).collect() == []


def test_tournament_is_first_fit():
    rng = np.random.default_rng(4)
    for _ in range(50):
        size = int(rng.integers(2, 50))
        sizes = sorted((int(x) for x in rng.integers(1, size + 1, int(rng.integers(0, 80)))), reverse=True)
        rows = packing.first_fit([(i, 0, n) for i, n in enumerate(sizes)], size)
        plain = []
        for i, n in enumerate(sizes):
            row = next((r for r in plain if sum(sizes[j] for j in r) + n <= size), None)
            if row is None:
                plain.append(row := [])
            row.append(i)
        assert [[p[0] for p in r] for r in rows] == plain
        lengths = [int(x) for x in rng.integers(1, 3 * size, len(sizes))]
        done = packing.packed(lengths, size)
        covered = [set() for _ in lengths]
        for row in done:
            t = sum(p[2] for p in row)
            assert t == size or t & (t - 1) == 0
            for doc, start, n in row:
                assert not covered[doc] & set(range(start, start + n))
                covered[doc] |= set(range(start, start + n))
        assert [len(c) for c in covered] == lengths
