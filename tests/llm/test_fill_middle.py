import hashlib
import re

import duckdb
import numpy as np
import pytest

from ridgelift.llm import fill_middle as fm

from .helpers import docs, tables

SF = "/root/testdata/sf0.01"
AWKWARD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb\nc"), (7, "a\r\nb\r\n"), (8, "é\n𝄞 λ\n"), (9, "has <S> itself\n"), (10, "<P>"), (11, "<\nP>\n<\nM>"), (12, "<<\n<S\nS>\n>"),
    (None, "x\ny\n"), (13, "long line\n" * 50_000), (14, "y" * 200_001), (15, "dup\n" * 3), (15, "dup\n" * 3), *[(100 + i, "".join(f"line {j}\n" for j in range(i))) for i in range(40)],
]


def plain(text, doc_id):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({fm.OP13_SQL})").fetchall())
    assert sorted(tuple(r) for r in fm.op13_fill_middle(spark, SF).select(*names).collect()) == want
    assert {r[2] for r in want} == {"psm", "spm"}


def test_awkward_documents(spark, tmp_path):
    path = tables(spark, tmp_path, documents=docs(spark, AWKWARD).withColumnRenamed("lang", "output"))
    key = lambda r: (str(r[0]), r[1:])
    got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in fm.op13_fill_middle(spark, path).collect()), key=key)
    want = sorted(((i, *plain(t, i)[:4], sha(plain(t, i)[4]), sha(t or "")) for i, t in AWKWARD), key=key)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_other_columns(spark):
    df = docs(spark, AWKWARD)
    made = fm.transform(df)
    assert made.columns == [*df.columns, "output", "form", "n", "prefix_chars", "middle_chars"]
    for r in fm.restore(made).collect():
        assert r["output"] == plain(r["text"], r["doc_id"])[4] and r["restored"] == (r["text"] or "")
    with pytest.raises(ValueError, match="form"):
        fm.transform(df.withColumnRenamed("lang", "form"))
    assert {r["form"] for r in fm.transform(df, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fm.transform(df, suffix_first=0).collect()} == {"plain", "psm"}


def test_no_documents(spark, tmp_path):
    assert fm.op13_fill_middle(spark, tables(spark, tmp_path, documents=docs(spark, []))).collect() == []


def test_rotation_across_buffers(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(fm, "SWAP", 7)
    for _ in range(200):
        data = rng.integers(0, 256, int(rng.integers(0, 100))).astype(np.uint8).tobytes()
        a, b, c = sorted(int(x) for x in rng.integers(0, len(data) + 1, 3))
        own = bytearray(data)
        fm.rotate(own, a, b, c)
        assert bytes(own) == data[:a] + data[b:c] + data[a:b] + data[c:]
        fm.rotate(own, a, a + c - b, c)
        assert bytes(own) == data
