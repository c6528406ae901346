import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from ridgelift.llm import nearest, pieces

from .helpers import DOCS, docs, tables

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def by_force(ids, x, k=5):
    out = {}
    for i in ids[ids % 50 == 0]:
        q = x[ids == i][0]
        s = np.array([sum(a * b for a, b in zip(q, v, strict=True)) / (np.sqrt(sum(a * a for a in q)) * np.sqrt(sum(b * b for b in v))) for v in x[ids != i]])
        best = np.lexsort((ids[ids != i], -s))[:k]
        out[int(i)] = [(int(ids[ids != i][b]), float(s[b])) for b in best]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = by_force(ids, x)
    got = {}
    for r in nearest.op4_nearest(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    norm = x / np.linalg.norm(x, axis=1, keepdims=True)
    place = {int(i): k for k, i in enumerate(ids)}
    for i, found in got.items():
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(float(norm[place[i]] @ norm[place[v]]), abs=1e-12) for _, v, s in found)
    recall = np.mean([len({v for _, v, _ in got[i]} & {v for v, _ in want[i]}) / 5 for i in want])
    assert recall >= 0.9


def test_ties_and_useless_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "SHARE_ROWS", 40)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8)
    rows = [(i, [float(v) for v in (hot if i % 3 == 0 else rng.normal(size=8))], 0) for i in range(600)]
    rows += [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [1.0] * 7 + [None], 0), (1150, [float("nan")] * 8, 0), (1200, [float("inf")] * 8, 0), (1250, [1.0], 0), (None, [1.0] * 8, 0), (0, rows[0][1], 0)]
    d = tables(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {}
    for r in nearest.op4_nearest(spark, d).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(got) == list(range(0, 600, 50))
    assert got[150] == {1: 0, 2: 3, 3: 6, 4: 9, 5: 12} and got[0] == {1: 3, 2: 6, 3: 9, 4: 12, 5: 15}


@pytest.mark.parametrize("scales", [[1e-200], [1e200], [1.0] * 299 + [1e-200], [1e-200, 1.0, 1e200, 5e-324, 1.7e308, -3.0]])
def test_very_small_and_large_numbers(spark, tmp_path, scales):
    rng = np.random.default_rng(9)
    unit = rng.uniform(0.5, 1.0, (300, 16)) * rng.choice([-1.0, 1.0], (300, 16))
    x = unit * np.array([scales[i % len(scales)] for i in range(300)])[:, None]
    d = tables(spark, tmp_path, embeddings=spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    power = np.exp2(np.floor(np.log2(np.abs(x).max(1)) / 2))[:, None]
    want = by_force(np.arange(300), x / power / power)  # cosines do not change
    got = {}
    for r in nearest.op4_nearest(spark, d).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    exact = lambda i, j: sum(a * b for a, b in zip(*(x[[i, j]] / power[[i, j]] / power[[i, j]]), strict=True)) / np.prod([np.sqrt((v * v).sum()) for v in x[[i, j]] / power[[i, j]] / power[[i, j]]])
    assert all(s == pytest.approx(exact(i, j), abs=1e-12) for i, found in got.items() for j, s in found.values())
    assert np.mean([len({v for v, _ in got[i].values()} & {v for v, _ in want[i]}) / 5 for i in want]) >= 0.9


def test_lists_are_packed_into_shares():
    first, over = nearest.shares_of({0: 5, 1: 4, 2: 30, 3: 1, 4: 9, 5: 2}, 7, 10)
    assert over == [1, 1, 3, 1, 1, 1, 1] and first == [0, 0, 1, 4, 4, 5, 5]


def test_clashing_columns_of_vectors(spark, tmp_path):
    rows = [(i, [float(i), 1.0, 2.0], i, "x") for i in range(120)]
    d = tables(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, q string"))
    assert nearest.op4_nearest(spark, d).count() == 15


def test_few_or_no_vectors(spark, tmp_path):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.op4_nearest(spark, tables(spark, tmp_path / "a", embeddings=few)).collect()] == [(0, 1, 7, 0.0)]
    assert nearest.op4_nearest(spark, tables(spark, tmp_path / "b", embeddings=few.limit(0))).count() == 0


ODD = [(1, None), (2, ""), (3, "  two  spaces and\ttab\n\nlines "), (4, "▁ marker \U0001f600 日本 \x00 end"), (None, "x" * 3000), (5, "É " * 2000), (5, "É " * 2000)]


def test_ids_equal_sentencepiece(spark):
    texts = ODD + [(r["doc_id"] + 10, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    df = pieces.encode(docs(spark, texts))
    rows = df.collect()
    assert len(rows) == len(texts) and all(r["parity"] for r in rows)
    for r in rows:
        assert r["ids"] == own.encode(r["text"]) and r["decoded"] == own.decode(r["ids"]) == r["text"].replace("▁", " ")
    back = pieces.decode(df.select("doc_id", "text", "ids")).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((r["doc_id"], r["decoded"])) for r in rows)


def test_digests(spark, tmp_path):
    rows = pieces.op8_sentencepiece(spark, tables(spark, tmp_path, documents=docs(spark, ODD))).collect()
    assert all(r["round_trip"] and r["parity"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_ids"] == by[2]["n_ids"] == 0 and by[4]["n_byte_ids"] > 0
    assert pieces.op8_sentencepiece(spark, tables(spark, tmp_path / "none", documents=spark.createDataFrame([], DOCS))).count() == 0


def lists(encoder, texts):
    """Ids, decoded texts and parity of a list of texts."""
    ids, size, decoded, parity = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(size)
    return [ids[e - n : e].tolist() for e, n in zip(ends, size, strict=True)], decoded.to_pylist(), parity.tolist()


def test_other_models_are_rebuilt():
    """A unigram model with a dummy prefix and squeezed spaces, written field by field."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    found = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    found += [(f"<0x{i:02X}>", -20.0, pieces.BYTE) for i in range(256)]
    found += [(p, s, pieces.NORMAL) for p, s in (("▁", -3.0), ("▁a", -2.0), ("b", -3.0), ("a", -3.5), ("ab", -2.5), ("▁ab", -4.0), ("c", -4.0), ("bc", -3.1))]
    data = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in found)
    data += message(2, b"\x18" + varint(pieces.UNIGRAM) + varint(35 << 3) + b"\x01") + message(3, message(1, b"identity"))
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab  abc a", " b", "cab xé", "", "a" * 20]
    ids, _, parity = lists(pieces.Encoder(data), texts)
    assert ids == own.encode(texts) and all(parity)


def test_ids_come_from_the_tokenizers_library():
    encoder = pieces.Encoder(pieces.model_bytes(pieces.MODEL_PATH))
    texts, encoder.own = ["  some words, and 日本", "", "▁▁ x"], None
    ids, size = encoder.rebuilt(pa.array(texts))
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).encode(texts)
    assert ids.tolist() == [i for w in want for i in w] and size.tolist() == [len(w) for w in want]


SQUEEZED = b"\x1a\x02\x20\x01"  # merged into the normaliser: extra white space is removed


def test_parity_holds_whole_raw_texts():
    """A model with squeezed spaces; then one whose rebuilt normaliser is spoilt, and one that is cut where pieces cross."""
    from tokenizers import normalizers

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).serialized_model_proto() + SQUEEZED
    texts = ["  fine  lift ", "\tA tab\n", "e\u0301 \u3000 x", "", "   ", "the lift"]
    want = sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts)
    ids, _, parity = lists(pieces.Encoder(model), texts)
    assert ids == want and all(parity)

    spoilt = pieces.Encoder(model)
    spoilt.norm = normalizers.Sequence([spoilt.norm, normalizers.Replace("f", "g")])
    ids, decoded, parity = lists(spoilt, texts)
    assert ids == want and parity == [False, True, True, True, True, False] and decoded[-1] == texts[-1]
    ids, decoded, parity = lists(spoilt, ["no such letter", "yes: f"])
    assert parity == [True, False] and decoded[1] == "yes: f"

    cut = pieces.Encoder(model)
    cut.segments = lambda t: (pa.array([c for x in t.to_pylist() for c in x], pa.string()), np.array([len(x) for x in t.to_pylist()], np.int64))
    ids, _, parity = lists(cut, texts)
    assert ids == want and not parity[-1]


def test_decoding_by_table_equals_the_library(spark):
    encoder = pieces.Encoder(pieces.model_bytes(pieces.MODEL_PATH))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [t or "" for _, t in ODD]
    ids, decoded, _ = lists(encoder, texts)
    whole = pieces.build(pieces.parse(pieces.model_bytes(pieces.MODEL_PATH)))
    assert decoded == whole.decode_batch(ids, skip_special_tokens=False)


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(docs(spark, ODD).withColumn("ids", pieces.F.lit(1)))


def test_only_spaces_are_squeezed():
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    data = own.serialized_model_proto() + SQUEEZED
    texts = [" \ta\n ", "a  b ", "\n"]
    ids, _, parity = lists(pieces.Encoder(data), texts)
    assert ids == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts) and all(parity)


def test_a_worker_gives_back_what_a_task_took(spark):
    seen = []

    class Frame:
        schema = docs(spark, [(1, "a")]).select("doc_id", "text").schema
        columns = ("doc_id", "text")

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
            return list(run(iter([batch])))

    given, pieces.words.give_back = pieces.words.give_back, lambda: seen.append(1)
    try:
        assert pieces.encode(Frame())[0].column("parity").to_pylist() == [True]
    finally:
        pieces.words.give_back = given
    assert len(seen) == 2  # after the tokenizer is built, and in the end
