import hashlib

import numpy as np
import pytest

from ridgelift.llm import edit_fingerprint as ef
from ridgelift.llm import quality

from .helpers import DOCS, docs, tables

SF = "/root/testdata/sf0.01"


def test_fingerprints_against_a_plain_walk(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "héllo wörld 𝄞 " * 40), (4, "another four"), (9, "x" * 5000), (None, "no id"), (7, "y z" * 70_000), (3, "ab"), (11, "last")]
    d = tables(spark, tmp_path, documents=docs(spark, rows))
    got = ef.op2_fingerprints(spark, d).collect()
    assert len(got) == len(rows)
    walk = ef.Walk()
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
    plain = {11: ("last", "x" * 5000), 9: ("x" * 5000, "y z" * 70_000), 2: ("", ""), None: ("no id", "last")}
    for i, (t, nxt) in plain.items():
        (r,) = texts[i]
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == walk.fingerprint(t) and r["edited_fingerprint"] == walk.fingerprint(edited)
        assert r["near_edited"] == ef.likeness(walk.fingerprint(t), walk.fingerprint(edited)) and r["near_next"] == ef.likeness(walk.fingerprint(t), walk.fingerprint(nxt))
    assert texts[2][0]["near_edited"] == 1.0 and texts[1][0]["near_next"] < 1


def test_next_of_every_document(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    by = {r["doc_id"]: r["text"] for r in docs_.collect()}
    ids = sorted(by, reverse=True)
    got = {r["doc_id"]: r for r in ef.op2_fingerprints(spark, SF).collect()}
    assert len(got) == len(ids)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(by[i])
        edited = by[i][: n - n // 3] + by[j][: n // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    near, far = (np.array([got[i][k] for i in ids]) for k in ("near_edited", "near_next"))
    assert 0.6 < np.median(near) < 0.8 and np.median(far) < 0.3 and (near >= far).mean() > 0.95


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefghij klmno"), 4000))
    walk, last = ef.Walk(), 1.0
    base = walk.fingerprint(text)
    for edits in (1, 40, 400, 2000):
        chars = list(text)
        for p in rng.integers(0, len(chars), edits):
            chars[p] = "#"
        now = ef.likeness(base, walk.fingerprint("".join(chars)))
        assert now <= last + 0.02
        last = now
    assert last < 0.6 and ef.likeness(base, walk.fingerprint(text[:2000] + "!" + text[2000:])) > 0.7


def groups_of(df, **how):
    return {r["fingerprint"]: r["near_group"] for r in ef.near_groups(df, **how).collect()}


def test_near_groups(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    walk = ef.Walk()
    base = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    prints = [walk.fingerprint(t) for t in base] + [walk.fingerprint(t[:-40] + "changed ending") for t in base]
    df = spark.createDataFrame([(p,) for p in [*prints, *prints[:5], None]], "fingerprint string")
    got = groups_of(df, least=0.8, bands=24)
    assert got.keys() == set(prints) and len(set(got.values())) == 30
    assert all(got[prints[i]] == got[prints[i + 30]] for i in range(30))


def test_near_groups_beside_a_smaller_unlike_print(spark):
    """{M, A, B}: M is smaller and shares each key of A, but is near neither; only A and B are."""
    octaves = 8
    rng = np.random.default_rng(2)
    a = rng.integers(2, 15, (octaves, ef.SAMPLES)).astype(np.uint8)
    picked = np.zeros(a.shape, bool)
    for k in (octaves, octaves - 1):
        picked[ef._picks(k, 24, 24)] = True
    b = np.where(rng.random(a.shape) < 0.05, 15, a).astype(np.uint8)
    m = np.where(picked, a, 1).astype(np.uint8)
    m, a, b = ("".join(f"{v:x}" for v in x.ravel()) for x in (m, a, b))
    assert m < a < b and ef.likeness(m, a) < 0.8 and ef.likeness(m, b) < 0.8 <= ef.likeness(a, b)
    got = groups_of(spark.createDataFrame([(m,), (a,), (b,)], "fingerprint string"), least=0.8, bands=24)
    assert got[a] == got[b] != got[m]


def test_near_groups_of_a_split_bucket(spark, monkeypatch):
    """Short formulaic texts: few buckets, dealt in blocks; the groups are those of all pairs."""
    monkeypatch.setattr(ef, "MEMBERS", 7)
    rng = np.random.default_rng(8)
    walk = ef.Walk()
    prints = sorted({walk.fingerprint("dear customer, your order number " + "".join(rng.choice(list("01"), 6)) + " has shipped") for _ in range(60)})
    group = {p: p for p in prints}
    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if ef.likeness(p, q) >= 0.9:
                old, new = group[q], group[p]
                group = {x: new if g == old else g for x, g in group.items()}
    got = groups_of(spark.createDataFrame([(p,) for p in prints], "fingerprint string"))
    assert len(set(group.values())) < len(prints)
    assert {frozenset(p for p in prints if got[p] == g) for g in got.values()} == {frozenset(p for p in prints if group[p] == g) for g in group.values()}


def test_recall_of_near_groups(spark):
    """Texts with a growing number of edits: pairs near by likeness end in one group, and unlike texts stay apart."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    walk, prints = ef.Walk(), []
    for _ in range(60):
        chars = list(" ".join(rng.choice(words, rng.integers(60, 400))))
        for edits in (0, 2, 5, 10, 20):
            for p in rng.integers(0, len(chars), edits):
                chars[p] = "#"
            prints.append(walk.fingerprint("".join(chars)))
    got = groups_of(spark.createDataFrame([(p,) for p in prints], "fingerprint string"))
    near = [(prints[5 * k + i], prints[5 * k + j]) for k in range(60) for i in range(5) for j in range(i) if ef.likeness(prints[5 * k + i], prints[5 * k + j]) >= ef.LEAST]
    assert len(near) > 100 and np.mean([got[p] == got[q] for p, q in near]) >= 0.99
    assert all(len({k for k in range(60) for i in range(5) if got[prints[5 * k + i]] == g}) == 1 for g in got.values())


def test_fingerprints_of_nothing(spark, tmp_path):
    assert ef.op2_fingerprints(spark, tables(spark, tmp_path, documents=spark.createDataFrame([], DOCS))).count() == 0


def test_quality_is_accurate_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in quality.op10_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_rules_compile_to_what_they_mean(spark):
    model = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert 0 < len(model.rules) < 200
    got = quality.with_statistics(docs(spark, [(1, "some words! AND\nlines"), (2, None), (3, "a")]), ["doc_id"])
    for r in got.select("doc_id", "_s", model.column().alias("score")).collect():
        logit = model.bias + sum(x.weight for x in model.rules if all((r["_s"][n] <= b) == m for n, m, b in x.conditions))
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_quality_of_odd_tables(spark):
    df = docs(spark, [(1, None), (2, ""), (None, "x y z"), (2, "")])
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.learn(df, nothing)
    assert quality.score(df, model, ["doc_id"]).count() == 4 and quality.keep_good(df, model).count() == 4
    one_class = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(df.withColumn("score", df.doc_id), quality.learn(df, one_class)).columns == [*df.columns, "score"]
    assert quality.score(spark.createDataFrame([], DOCS), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize(("ranges", "coarse"), [(1, 1000), (7, 1000), (40, 5), (300, 1000)])
def test_ranges_are_in_order_and_even(spark, monkeypatch, ranges, coarse):
    """Ranges follow each other by descending id, then hash; a hot id is dealt over several, and each range ends with the next one's first row."""
    monkeypatch.setattr(ef, "COARSE", coarse)
    rng = np.random.default_rng(8)
    ids = [int(i) for i in rng.integers(-(2**62), 2**62, 900)] + [5] * 700 + [2**63 - 1, -(2**63)] + [None] * 60
    df = docs(spark, [(i, f"text {k} of {i}") for k, i in enumerate(ids)])
    got = ef.in_order(df, ranges).collect()
    rows = sorted((r for r in got if not r["_donor"]), key=lambda r: (r["_bucket"], r["doc_id"] is None, -(r["doc_id"] or 0), r["_th"]))
    assert sorted(r["text"] for r in rows) == sorted(f"text {k} of {i}" for k, i in enumerate(ids))
    order = [(r["doc_id"] is None, -(r["doc_id"] or 0), r["_th"]) for r in rows]
    assert order == sorted(order)
    used = sorted({r["_bucket"] for r in rows})
    first = {b: next(r for r in rows if r["_bucket"] == b) for b in used}
    donors = {r["_bucket"]: r["text"] for r in got if r["_donor"]}
    assert donors == {b: first[c]["text"] for b, c in zip(used, used[1:] + used[:1], strict=True)}
    if ranges >= 40:
        assert max(sum(r["_bucket"] == b for r in rows) for b in used) < 0.15 * len(rows) and len({r["_bucket"] for r in rows if r["doc_id"] == 5}) > 5


def test_weights_meet_the_conditions_of_the_lasso():
    """At the optimum the gradient of a rule's standardised weight is the penalty against its sign, that of the bias is nothing; and unseen rows are told apart."""
    rng = np.random.default_rng(11)

    def rows(n):
        x = rng.normal(size=(n, len(quality.STATISTICS)))
        logit = 2.5 * (x[:, 0] > 0.3) * (x[:, 1] <= 0.5) - 2.0 * (x[:, 2] > 1) - 0.5
        return x, (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)

    (x, y), (new_x, new_y) = rows(4000), rows(4000)
    penalty = 0.002
    model = quality.fit(x, y, penalty=penalty)
    place = {n: j for j, n in enumerate(quality.STATISTICS)}

    def holds(x, rule):
        return np.all([(x[:, place[n]] <= b) == m for n, m, b in rule.conditions], axis=0).astype(float)

    def probability(x):
        return 1 / (1 + np.exp(-(model.bias + sum(r.weight * holds(x, r) for r in model.rules))))

    error = probability(x) - y
    assert abs(error.mean()) < 1e-3 and len(model.rules) > 5
    for r in model.rules:
        a = holds(x, r)
        scale = max(a.std(), 0.02)
        if abs(r.weight * scale) > 0.02:
            assert ((a - a.mean()) / scale) @ error / len(y) == pytest.approx(-penalty * np.sign(r.weight), abs=penalty / 4)
    order = np.argsort(np.argsort(probability(new_x), kind="stable"))
    ones = new_y == 1
    auc = (order[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())
    ideal = 1 / (1 + np.exp(-(2.5 * (new_x[:, 0] > 0.3) * (new_x[:, 1] <= 0.5) - 2.0 * (new_x[:, 2] > 1) - 0.5)))
    best = np.argsort(np.argsort(ideal, kind="stable"))
    assert auc > (best[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum()) - 0.03
