import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from ridgelift.llm import components, near_dup, words
from ridgelift.llm import substring_dedup as sd

from .helpers import DOCS, docs, tables

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_by_force(rows, percent, n):
    """{place of the row: component id}."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def altered(rng, text, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"x{rng.integers(1_000_000)}"
    return " ".join(w)


def some_documents(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "two one"), (None, "one two"), (7, " \t"), (7, " \t")]
    for k in range(25):
        base = " ".join(rng.choice(vocabulary, rng.integers(20, 200)))
        for c in range(12):
            rows.append((1000 * k + c + 10, altered(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.08]))))
    return [*rows, (10, rows[9][1]), (None, "no other text is like this"), (None, "no other text is like this")]


@pytest.mark.parametrize(("percent", "n"), [(85, 3), (80, 5)])
def test_near_dups_against_all_pairs(spark, percent, n):
    rows = some_documents()
    got = near_dup.classes(docs(spark, rows), percent, n).collect()
    want = sorted(((d, c, len(shingles(t, n))) for (d, t), c in zip(rows, near_by_force(rows, percent, n), strict=True)), key=str)
    assert sorted(((r["_id"], r["component"], r["n_shingles"]) for r in got), key=str) == want


def test_near_dups_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = some_documents(9)
    got = near_dup.classes(docs(spark, rows), 85, 3).collect()
    assert sorted((str(r["_id"]), str(r["component"])) for r in got) == sorted((str(d), str(c)) for (d, _), c in zip(rows, near_by_force(rows, 85, 3), strict=True))


@pytest.mark.parametrize(("members", "hashes"), [(2, 1_500_000), (10_000, 400)])
def test_near_dups_in_families_of_many_blocks(spark, monkeypatch, members, hashes):
    monkeypatch.setattr(near_dup, "FAMILY", members)
    monkeypatch.setattr(near_dup, "FAMILY_HASHES", hashes)
    rows = some_documents(7)
    got = near_dup.classes(docs(spark, rows), 85, 3).collect()
    assert sorted((str(r["_id"]), str(r["component"])) for r in got) == sorted((str(d), str(c)) for (d, _), c in zip(rows, near_by_force(rows, 85, 3), strict=True))


def test_very_long_texts_are_one_set(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FAMILY_HASHES", 40_000)
    long = [f"w{i}" for i in range(90_000)]
    rows = [(i, " ".join([*long[: 89_990 - i], f"end{i}"])) for i in range(3)] + [(7, "a few words here now"), (8, "a few words here now"), (9, " ".join(f"v{i}" for i in range(50)))]
    got = near_dup.classes(docs(spark, rows), 85, 3).collect()
    assert sorted((r["_id"], r["component"]) for r in got) == [(0, 0), (1, 0), (2, 0), (7, 7), (8, 7), (9, 9)]


CLASHES = ("_row_th", "_id", "_th", "label", "row", "row_id", "component", "_size", "_draw", "_source", "_copies", "_copy", "ids", "_t", "_w", "_s", "spans", "kept", "h")


def test_clashing_columns_pass_untouched(spark):
    from ridgelift.llm import mixing, quality, secret_scan

    df = docs(spark, [(1, "some words of a text " * 4, "a"), (2, "some words of a text " * 4, "b"), (3, None, None)])
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, near_dup.F.lit(i) + near_dup.F.col("doc_id"))
    model = quality.Model((), 5.0)
    for out in (near_dup.keep_one(df), mixing.mix(df), quality.keep_good(df, model), secret_scan.redact(df)):
        rows = out.collect()
        assert out.columns == df.columns and rows
        assert all(r[c] == i + r["doc_id"] for r in rows for i, c in enumerate(CLASHES))
    with pytest.raises(ValueError, match="_size"):
        mixing.with_copies(df)
    plain = df.select("doc_id", "text")
    for own in (sd.remove, lambda d: near_dup.classes(d, 85, 3)):
        assert sorted(map(str, own(df).collect())) == sorted(map(str, own(plain).collect()))


def test_keep_one_of_each_group(spark):
    rows = some_documents()
    df = docs(spark, rows).withColumnRenamed("source", "label")
    kept = near_dup.keep_one(df)
    comps = near_by_force(rows, 80, 5)
    groups = {c for (d, t), c in zip(rows, comps, strict=True) if c is not None and (t or "").split()}
    ids = [r["doc_id"] for r in kept.where("doc_id is not null and length(trim(text)) > 1").collect()]
    assert kept.columns == df.columns and sorted(ids) == sorted(groups)
    assert kept.where("doc_id is null").count() == 1  # the group without any id keeps one row
    assert kept.where("text is null or trim(text) in ('', '\t')").count() == 4


def test_a_stage_has_one_python_worker_a_task(spark, monkeypatch):
    plans, stored = [], near_dup.common.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan())
        return stored(df)

    def most(node):
        """Python functions in the stage of this node, and the most in any stage below."""
        below = [most(node.children().apply(i)) for i in range(node.children().size())]
        own, other = max((b[0] for b in below), default=0), max((b[1] for b in below), default=0)
        if "Exchange" in node.nodeName():
            return 0, max(own, other)
        return own + (node.nodeName() == "MapInArrow"), other

    monkeypatch.setattr(near_dup.common, "stored", seen)
    rows = [(i, f"{'one two three four five six seven eight nine ten ' * 3} w{i % 3}") for i in range(6)]
    assert {r["component"] for r in near_dup.classes(docs(spark, rows), 50, 3).collect()} == {0}
    assert max(max(most(p)) for p in plans) == 1


def test_near_dup_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(tuple(r) for r in near_dup.op9_near_dup(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()) == sorted(con.execute(near_dup.OP9_SQL).fetchall())


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    scheme = near_dup.Scheme(85, 3)
    for j in (0.95, 0.85):
        n = 2000
        both = round(n * 2 * j / (1 + j))
        x = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        s = scheme.sketches(scheme.minhash([x[:n], np.concatenate([x[:both], x[n : 2 * n - both]])]))
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        got = 1 + near_dup.BITS / (4 * scheme.k) * np.log(1 - 2 * z / near_dup.BITS)
        assert abs(got - j) < 0.1 and z <= scheme.most_bits


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut_by_force(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        out.append((d, len(r), int(gone.sum()), int((edge == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return sorted(out, key=str)


def repeats(seed, size):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("abcdefghij é"), n))
    passage = [text(size * 2), text(size), text(size + 3), "ab" * size]
    rows = [(1, None), (2, ""), (3, "short"), (4, passage[0][: size - 1]), (None, text(50) + passage[1]), (None, passage[1])]
    for i in range(40):
        p = passage[i % 4]
        rows.append((10 + i, text(rng.integers(0, 60)) + p[rng.integers(0, 4) : len(p) - rng.integers(0, 4)] + text(rng.integers(0, 60)) + (p if i % 9 == 0 else "")))
    return [*rows, (10, rows[6][1]), (99, "periodic " * size), (98, text(size * 3))]


@pytest.mark.parametrize("length", [12, 40, 60])
def test_substrings_against_all_strings(spark, length):
    rows = repeats(length, length)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.remove(docs(spark, rows), length).collect()), key=str)
    assert got == cut_by_force(rows, length)


@pytest.mark.parametrize(("block", "split", "levels"), [(1 << 20, 300, 4), (200, 300, 2), (200, 1 << 20, 1), (1, 1, 3)])
def test_substrings_in_large_buckets(spark, monkeypatch, block, split, levels):
    for name, value in (("BLOCK", block), ("SPLIT", split), ("LEVELS", levels)):
        monkeypatch.setattr(sd, name, value)
    rows = repeats(5, 40)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.remove(docs(spark, rows), 40).collect()), key=str)
    assert got == cut_by_force(rows, 40)


@pytest.mark.parametrize("length", [12, 40, 60, 400])
def test_classes_are_equal_strings(length):
    rng = np.random.default_rng(length)
    part = rng.integers(0, 3, length * 2, dtype=np.uint8)
    data = np.concatenate([part, rng.integers(0, 256, length, dtype=np.uint8), part[3:], np.zeros(length * 2, np.uint8), part[: length + 5]])
    starts = np.arange(len(data) - length + 1)
    raw = data.tobytes()
    seen = {}
    want = [seen.setdefault(raw[i : i + length], i) for i in starts]
    got = sd.classes(data, starts, length)
    assert len(set(zip(want, got.tolist(), strict=True))) == len(seen) == len(set(got.tolist()))


def test_ranks_are_in_byte_order():
    data = np.random.default_rng(2).integers(0, 4, 500, dtype=np.uint8)
    at = np.arange(0, 480)
    for v in (1, 8, 10, 20):
        keys = [data[i : i + v].tobytes() for i in at]
        place = {k: i for i, k in enumerate(sorted(set(keys)))}
        assert sd._ranks(data, at, v).tolist() == [place[k] for k in keys]


def test_substrings_of_the_corpus(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in cut_by_force(rows, 400)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.op6_substring_dedup(spark, SF).collect()), key=str)
    assert got == want


def test_cover_and_minima():
    cover, shift = sd.difference_cover(80)
    assert len(cover) < 20 and all((a + shift[a, b]) % 80 in cover and (b + shift[a, b]) % 80 in cover for a in range(80) for b in range(80))
    x = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    assert [int(v) for v in sd.sliding_min(x, 7)] == [int(x[i : i + 7].min()) for i in range(94)]


def test_dedup_of_nothing(spark, tmp_path):
    d = tables(spark, tmp_path, documents=spark.createDataFrame([], DOCS))
    assert near_dup.op9_near_dup(spark, d).count() == 0 and sd.op6_substring_dedup(spark, d).count() == 0


def test_words_of_a_batch():
    import pyarrow as pa

    texts = [" A\x0bb\x1cc  D", "", "É x", "\x85y"]
    codes, counts, distinct = words.word_codes(pa.array(texts))
    want = [t.encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert [distinct[int(c)].as_py().encode() for c in codes] == [x for w in want for x in w]
