import hashlib
import re

import duckdb
import pytest

from ridgelift.llm import license_scan, mixing, secret_scan

from .helpers import DOCS, docs, tables

SF = "/root/testdata/sf0.001"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "MIT License mit-license, the Apache\nLicense"), (5, "general public"), (5, "general public license"),
    (5, "general public license"), (None, "MIT license"), (6, "é mit é license É MIT\x00LICENSE ümit license"), (7, "Licensed under CC BY-NC 4.0. " * 3),
    (8, "word " * 63 + "mit license " + "word " * 5000 + "mit license"), (9, "license mit under the released under"), (10, "mIt LICENSE" * 2),
]


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def same_base(rows, texts):
    want = sorted(((i, *base_of(t)) for i, t in texts), key=str)
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=str)
    assert got == want


def test_license_scan_on_odd_texts(spark):
    rows = license_scan.scan_documents(docs(spark, ODD)).collect()
    same_base(rows, ODD)
    by = {r["doc_id"]: r for r in rows}
    assert "cc-by-nc" in by[7]["labels"] and by[7]["score"] == 1.0
    assert by[1]["score"] == 0.0 and by[1]["labels"] == ""
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_license_scan_finds_every_block_over_the_threshold(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = license_scan.op1_license_scan(spark, SF).collect()
    same_base(rows, texts)
    found = {(m["_id"], m["block"], m["tid"]) for m in license_scan.scan(docs(spark, texts), license_scan.NOTICES).collect()}
    overlap = max(len(t.words) for t in license_scan.NOTICES) - 1
    for i, t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        for b in range(0, len(words), license_scan.STRIDE):
            block = set(words[b : b + license_scan.STRIDE + overlap])
            for k, n in enumerate(license_scan.NOTICES):
                s = set(n.words)
                assert (len(s & block) >= n.threshold * len(s) - 1e-9) == ((i, b // license_scan.STRIDE, k) in found)


def test_license_scan_of_nothing(spark):
    assert license_scan.scan_documents(spark.createDataFrame([], DOCS)).count() == 0


def spans_of(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate((("assign", secret_scan.ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(group)) >= least:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


SECRETS = [
    (1, None), (2, ""), (3, "Password = 'hunter22' passſword=hunter22 API_key:abcdef apikey = short"), (4, "x AKIA" + "A1" * 8 + " AKIAAKIA" + "Z" * 30),
    (5, "é" * 50 + "0123456789abcdef01234567" + "é token=" + "ab12" * 9), (5, "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----"), (6, "secret:secret:password123"),
    (7, "a" * 23 + " " + "b" * 24 + " " + "0" * 200_000), (None, "token=abcdef"), (8, "https://me:hunter2222@host/ eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM"),
]


def test_secret_scan_against_plain_regular_expressions(spark, tmp_path):
    texts = SECRETS + [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = secret_scan.op7_secret_scan(spark, tables(spark, tmp_path, documents=docs(spark, texts))).collect()
    assert len(rows) == len(texts)
    key = lambda x: (str(x[0]), x[1])
    want = sorted(((i, hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans_of(t)).encode()).hexdigest()) for i, t in texts), key=key)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in rows), key=key) == want
    all_spans = {s.split(":")[0] for r in rows for s in r["spans"].split(",") if s}
    assert {"assign", "access", "hex", "code-host-token", "private-key", "url-password", "web-token"} <= all_spans


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") == []
    (clause,) = secret_scan.trigram_query(r"AKIA[A-Z0-9]+")
    assert clause == [frozenset({"aki", "kia"})]
    (clause,) = secret_scan.trigram_query(secret_scan.ASSIGN)
    # six keywords, each followed by either quote or none
    words = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    want = {frozenset((w + q)[i : i + 3] for i in range(len(w + q) - 2)) for w in words for q in ("", "'", '"')}
    assert set(clause) == want


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_index_keeps_every_match(rule):
    texts = ["password: abcdefg", "xoxb-0123456789", "AIza" + "a" * 35, "sk_live_" + "a" * 20, "ASIA" + "A" * 16, "nothing"] + [t for _, t in SECRETS if t]
    queries, index = secret_scan._prepared((rule,))
    got = secret_scan.find_spans(texts, (rule,), index, queries)
    for t, spans in zip(texts, got, strict=True):
        assert [(a, b) for a, _, b in spans] == [m.span() for m in re.finditer(rule.pattern, t, re.ASCII) if len(m.group(rule.group)) >= rule.least]


def test_redaction_keeps_rows_and_columns(spark):
    df = docs(spark, SECRETS)
    out = secret_scan.redact(df)
    assert out.schema == df.schema
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[1] is None and by[2] == "" and "hunter22" not in by[3].replace("passſword=hunter22", "") and out.count() == df.count()


def test_secret_scan_of_nothing(spark, tmp_path):
    d = tables(spark, tmp_path, documents=spark.createDataFrame([], DOCS))
    assert secret_scan.op7_secret_scan(spark, d).count() == 0


def fill(sizes, weights, most):
    """Reshares the excess until none is above, the plain way."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > most * sizes[s]}
        if not full:
            target |= {s: w[s] * level for s in free}
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 2000, "c": 30, "d": 5, None: 700}, {"a": 0, "b": 0}, {"z": 1}, {"a": 1, "b": 1, "c": 1000, "é": 0}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(fill(sizes, mixing.WEIGHTS, 3))


def test_mix(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 5}" if i % 11 else None) for i in range(3000)] + [(None, None, "s1"), (3, "again", "s1"), (3, "again", "s1")]
    df = docs(spark, rows)
    a, b = mixing.with_copies(df), mixing.with_copies(df.repartition(7))
    got = sorted(((r["doc_id"], r["_copies"]) for r in a.collect()), key=str)
    assert got == sorted(((r["doc_id"], r["_copies"]) for r in b.collect()), key=str) and len(got) == len(rows)
    assert all(0 <= c <= 3 for _, c in got)
    per = {}
    for r in a.collect():
        p = r["_target"] / r["_source_size"] % 1
        x = per.setdefault(r["source"], [0, r["_target"], 0.0])
        x[0], x[2] = x[0] + r["_size"] * r["_copies"], x[2] + r["_size"] ** 2 * p * (1 - p)
    assert len(per) == 6
    for taken, target, variance in per.values():  # independent draws: within four standard deviations
        assert abs(taken - target) <= 4 * variance**0.5
    assert mixing.mix(df).count() == sum(c for _, c in got) and mixing.mix(df).columns == df.columns


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(mixing.OP3_SQL).fetchall())
    assert sorted(tuple(r) for r in mixing.op3_mixing(spark, SF).collect()) == want


def test_mixing_of_nothing(spark):
    assert mixing.with_copies(spark.createDataFrame([], DOCS)).count() == 0
