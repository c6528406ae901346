import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ridgelift.llm import ranked_search as rs

from .helpers import docs, tables

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(rs.TERM, (text or "").translate(LOWER))


def by_force(rows, items, k=10):
    """(item_id, rank, doc_id, score), from the definition alone."""
    counted = [(i, Counter(terms(t))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc, score))
        out += [(item, rank, x[2], x[3]) for rank, x in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted(con.execute(rs.OP11_SQL).fetchall())
    assert rows_of(rs.op11_ranked_search(spark, SF)) == want and len(want) == 400


AWKWARD = [
    (1, "red fox"), (2, "Red FOX!"), (3, "red fox"), (3, "red fox"), (4, None), (5, ""), (6, "..."), (7, "fox " * 5000), (8, "été λόγος red"), (9, "a\x00b_c-d 0x1F"),
    (None, "red fox"), (11, "x" * 100_000 + " red"), *[(100 + i, "blue sky over red hills") for i in range(300)],
]


def test_awkward_documents_and_items(spark, tmp_path):
    asked = [(1, "red fox"), (2, "BLUE blue hills"), (3, None), (4, ""), (5, "nowhere seen"), (6, "été b c 0x1f"), (7, "red")]
    found = tables(spark, tmp_path, documents=docs(spark, AWKWARD).withColumnRenamed("lang", "score").repartition(3), benchmark=items(spark, [*asked, asked[0]]))
    assert rows_of(rs.op11_ranked_search(spark, found)) == by_force(AWKWARD, asked)


def test_empty_tables(spark, tmp_path):
    one = tables(spark, tmp_path / "a", documents=docs(spark, []), benchmark=items(spark, [(1, "red")]))
    two = tables(spark, tmp_path / "b", documents=docs(spark, AWKWARD), benchmark=items(spark, []))
    three = tables(spark, tmp_path / "c", documents=docs(spark, [(1, None), (2, "?!")]), benchmark=items(spark, [(1, "red")]))
    for d in (one, two, three):
        assert rows_of(rs.op11_ranked_search(spark, d)) == []


@pytest.mark.parametrize(("entries", "item_bytes"), [(200, 1 << 20), (2_000_000, 150)])
def test_many_blocks_and_batches(spark, monkeypatch, entries, item_bytes):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(vocabulary[min(59, int(x))] for x in rng.geometric(0.08, n))
    rows = [(i, make(int(rng.integers(1, 40)))) for i in range(400)]
    asked = [(i, make(6)) for i in range(25)]
    monkeypatch.setattr(rs, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(rs, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(rs.blocks, "__defaults__", (entries,))
    assert rows_of(rs.search(docs(spark, rows).repartition(4), items(spark, asked), 5)) == by_force(rows, asked, 5)


def test_bounds_hold_and_subtrees_are_left_out():
    """A node's bound is never below a score under it; a search opens few nodes, and finds what all scores say."""
    rng = np.random.default_rng(5)
    made = []
    for i in range(3000):
        ranks = np.unique(rng.geometric(0.05, int(rng.integers(1, 30)))).astype(np.int64)
        made.append((i, int(rng.integers(10, 300)), ranks, rng.integers(1, 6, len(ranks))))
    tree = rs.Tree(made)
    weights = np.zeros(1000, np.int64)
    asked = np.array([1, 4, 20, 50, 70])
    weights[asked] = [10, 900, 3000, 5000, 7000]
    exact = {i: int((weights[r] * rs.impact(tf, np.array(m))).sum()) for i, m, r, tf in made}
    for at, (low, high) in enumerate(zip(tree.low, tree.high, strict=True)):
        if tree.children[at]:
            terms, shares, starts = tree.bounds[at]
            bounds = np.add.reduceat(weights[terms] * shares, starts)
            for c, bound in zip(range(*tree.children[at]), bounds, strict=True):
                assert bound >= max(exact[i] for i in tree.ids[tree.low[c] : tree.high[c]].tolist())
        assert high - low <= rs.LEAF or tree.children[at]

    class Seen(list):
        opened = 0

        def __getitem__(self, at):
            Seen.opened += 1
            return list.__getitem__(self, at)

    tree.bounds, best = Seen(tree.bounds), []
    rs.best_of(tree, weights, best, 10)
    assert sorted(((s, -d) for s, d in best), reverse=True) == sorted(((s, d) for d, s in exact.items() if s), key=lambda x: (-x[0], x[1]))[:10]
    assert Seen.opened < len(tree.low) / 2
