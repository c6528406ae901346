"""Metric paths and first differences: every form of path, and what is refused."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ridgelift.operators import paths

PROFILE = "site struct<elevation_m:double>, hours array<struct<surface:struct<t:double,w:struct<gust:double>>,derived:struct<top:struct<members:int,p10:double,p50:double>>,levels:array<struct<pressure_hpa:double,height_m:double,t:double>>>>"


@pytest.fixture
def profile(spark):
    levels = [(900.0, 1000.0, 1.0), (850.0, 1500.0, 2.0), (800.0, 2000.0, 3.0), (700.0, None, 4.0)]
    return spark.createDataFrame([((300.0,), [((20.0, (9.0,)), ((5, 1.0, 2.0),), levels), ((21.0, None), None, [])])], PROFILE)


@pytest.mark.parametrize(
    ("text", "how", "want"),
    [
        ("site.elevation_m", {}, 300.0),
        ("surface.t", {"hour": 1}, 21.0),
        ("surface.w.gust", {"hour": 0}, 9.0),
        ("surface.w.gust", {"hour": 1}, None),
        ("surface.t", {"hour": 2}, None),
        ("derived.top.p50", {"hour": 0}, 2.0),
        ("derived.top.p50", {"hour": 1}, None),
        ("level.t", {"hour": 0, "pressure_hpa": 850.0}, 2.0),
        ("level.t", {"hour": 0, "pressure_hpa": 851.0}, None),
        ("level.t", {"hour": 0, "near_height_m": 1250.0}, 1.0),
        ("level.t", {"hour": 0, "near_height_m": 9999.0}, 3.0),
        ("level.t", {"hour": 1, "near_height_m": 0.0}, None),
    ],
)
def test_values(profile, text, how, want):
    assert profile.select(paths.metric(profile, text, **how)).head()[0] == want


@pytest.mark.parametrize(
    ("text", "how"),
    [("surface", {"hour": 0}), ("sky.t", {"hour": 0}), ("surface.", {"hour": 0}), ("surface.x", {"hour": 0}), ("surface.t", {}), ("site.elevation_m", {"hour": 0}), ("surface.t.p50", {"hour": 0}), ("derived.top.p90", {"hour": 0}), ("level.t", {"hour": 0}), ("level.t", {"hour": 0, "pressure_hpa": 1.0, "near_height_m": 1.0}), ("surface.t", {"hour": 0, "pressure_hpa": 1.0}), ("launch.t", {}), ("smoke.t", {"hour": 0})],
)
def test_refused(profile, text, how):
    with pytest.raises(ValueError, match=r"[a-z]"):
        paths.metric(profile, text, **how)


def plain(a, b, path=""):
    if a == b and type(a) is type(b):
        return None
    if isinstance(a, (dict, list)) and isinstance(b, (dict, list)):
        a, b = (x if isinstance(x, dict) else {str(i): v for i, v in enumerate(x)} for x in (a, b))
        for key in sorted({*a, *b}):
            found = plain(a.get(key, ...), b.get(key, ...), f"{path}.{key}" if path else key)
            if found:
                return found
        return None
    if {type(a), type(b)} <= {int, float} and a == b:
        return None
    return path


def test_differences(spark):
    docs = [
        {}, {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": None}, {"a": {"b": [1, 2, {"c": True}]}}, {"a": {"b": [1, 2, {"c": False}]}}, {"a": {"b": [1, 2]}, "a-b": 1}, {"a": {"b": [1, 2]}, "a-b": 2, "A": 3}, {"a": []}, {"a": {}}, {"a": {"0": 5}}, {"a": [5]}, [1], {"é": "λ"}, {"é": "μ"},
    ]
    pairs = [(i * 100 + j, json.dumps(a), json.dumps(b)) for i, a in enumerate(docs) for j, b in enumerate(docs)]
    got = {r["id"]: r["path"] for r in paths.first_differences(spark.createDataFrame(pairs, "id long, a string, b string")).collect()}
    want = {i * 100 + j: plain(a, b) for i, a in enumerate(docs) for j, b in enumerate(docs)}
    assert got == {k: v for k, v in want.items() if v}
    deep = [(1, '{"a":{"b":{"c":1}}}', '{"a":{"b":{"c":2}}}'), (2, None, '{"x":1}'), (3, "{", "{}")]
    rows = paths.first_differences(spark.createDataFrame(deep, "id long, a string, b string"), depth=2).collect()
    assert {r["id"]: (r["path"], r["a"], r["b"]) for r in rows} == {1: ("a.b", '{"c":1}', '{"c":2}'), 2: ("x", "undefined", "1.0")}


def joined(pairs, depth):
    """First differences of the two documents' nodes, as rows joined by path."""
    a, b = (paths.flattened(pairs.select("id", F.col(c).alias("json")), depth).select("id", "path", F.struct("kind", "text").alias(c)) for c in ("a", "b"))
    both = a.join(b, ["id", "path"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    first = both.groupBy("id").agg(F.min_by(F.struct("path", "a", "b"), "path").alias("d"))
    return first.select("id", F.array_join("d.path", ".").alias("path"), *[F.coalesce(F.col(f"d.{c}.text"), F.lit("undefined")).alias(c) for c in ("a", "b")])


def test_differences_are_those_of_joined_nodes(spark):
    """Odd JSON included; and one row a pair is walked, without a shuffle of its nodes."""
    rng = random.Random(9)
    scalars = ["1", "1.0", "10e-1", "-0", "-0.0", "-0e0", "0", "1e999", "12345678901234567890123", "0.1", "1e-7", "1.50", "1.5", "9" * 1001, "NaN", "01", "1.", '"1"', '"\\u00e9"', '"é"', '"\\ud800"', '"?"', "true", "null", '"[object]"', "{}", "[]"]

    def text(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(scalars if rng.random() < 0.5 else scalars[:3] + scalars[-2:])
        n = rng.randrange(4)
        if rng.random() < 0.4:
            return "[" + ",".join(text(depth - 1) for _ in range(n)) + "]"
        keys = [rng.choice(["a", "b", "0", "1", "10", "2", "a.b", "é", "\U0001f600", "\uffff"]) for _ in range(n)]
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=rng.random() < 0.5)}:{text(depth - 1)}" for k in keys) + "}"

    whole = [text(4) for _ in range(500)]
    altered = [w if rng.random() < 0.1 else w.replace(rng.choice(["1", "a", "{}", "0"]), rng.choice(["2", "b", "[]", "1.0"]), 1) if rng.random() < 0.8 else text(4) for w in whole]
    odd = ["", " ", "{} x", '{"a":1} {', '{"a":1,"a":2}', "{'a':1}", '{"a":1,}', '\t{"a":1}', '\u00a0{"a":1}', '{"a":"\t"}', '{"a":1}', "[1,2", '"a"', "null", None, "[" * 1001 + "]" * 1001, "[" * 900 + "]" * 900, '{"a":+1}', '{"a":.5}', '{"a":Infinity}', "/**/{}", '{"a":"\\x"}', '{"a":"\\u12"}']
    rows = list(zip(whole, altered, strict=True)) + [(x, y) for x in odd for y in ('{"a":1.0}', "{}", "[[]]", None)]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a string, b string")
    for depth in (1, 2, 8):
        want, found = ({r["id"]: tuple(r)[1:] for r in d.collect()} for d in (joined(pairs, depth), paths.first_differences(pairs, depth)))
        assert {i: (rows[i], found.get(i), want.get(i)) for i in found.keys() | want.keys() if found.get(i) != want.get(i)} == {}, depth
    assert len(want) > 150
    assert "Exchange" not in paths.first_differences(pairs)._jdf.queryExecution().executedPlan().toString()
