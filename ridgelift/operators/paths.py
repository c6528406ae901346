"""Paths into documents: a metric path compiled into one column, and the first place where two documents differ."""

from __future__ import annotations

import json
import re
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERCENTILES = ("p10", "p25", "p50", "p75", "p90")
HOUR_BLOCKS = {"surface": "surface", "derived": "derived", "smoke": "smoke", "level": "levels"}
SITE_BLOCKS = ("site", "launch")
OBJECT = "[object]"


@dataclass(frozen=True)
class Path:
    block: str
    name: str
    percentile: str | None = None


def parse(text: str) -> Path:
    """block.name or block.name.percentile; a last part that is no percentile belongs to the name."""
    m = re.fullmatch(r"([a-z]+)\.([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)", text)
    if not m or m[1] not in (*HOUR_BLOCKS, *SITE_BLOCKS):
        raise ValueError(f"{text} is no metric path: a block ({', '.join((*SITE_BLOCKS, *HOUR_BLOCKS))}), a name, and perhaps one of {', '.join(PERCENTILES)}")
    name, _, last = m[2].rpartition(".")
    return Path(m[1], name, last) if name and last in PERCENTILES else Path(m[1], m[2])


def _field(kind: T.DataType, name: str, text: str) -> T.DataType:
    if not isinstance(kind, T.StructType) or name not in kind.names:
        raise ValueError(f"{text}: there is no {name}")
    return kind[name].dataType


def metric(profiles: DataFrame, text: str, hour: int | None = None, pressure_hpa: float | None = None, near_height_m: float | None = None) -> Column:
    """The value at a path of profiles (site and launch structs; hours: array of structs with surface, derived, smoke and levels), checked against their schema before anything runs.

    Blocks of an hour need its place from 0; `level` needs the pressure of a level, or the height that the nearest level is for (the first of equally near ones). Hours and levels that a profile
    does not have give null. A percentile is taken of an ensemble's block; anything else has none and is refused.
    """
    path = parse(text)
    if (hour is None) == (path.block in HOUR_BLOCKS):
        raise ValueError(f"{text}: " + ("an hour is needed" if hour is None else "no hour belongs to it"))
    if (path.block == "level") != ((pressure_hpa is None) != (near_height_m is None)):
        raise ValueError(f"{text}: a level needs a pressure or a height, other blocks neither")
    if path.block in SITE_BLOCKS:
        kind, at = _field(profiles.schema, path.block, text), F.col(path.block)
    else:
        hours = _field(profiles.schema, "hours", text)
        field = HOUR_BLOCKS[path.block]
        kind, at = _field(hours.elementType, field, text), F.get("hours", F.lit(hour))[field]
    if path.block == "level":
        kind = kind.elementType
        if pressure_hpa is not None:
            at = F.get(F.filter(at, lambda v: v["pressure_hpa"] == pressure_hpa), F.lit(0))
        else:
            far = F.transform(at, lambda v, i: F.struct(F.abs(v["height_m"] - near_height_m).alias("far"), i.alias("i")))
            at = F.get(at, F.array_min(F.filter(far, lambda x: x["far"].isNotNull()))["i"])
    for name in path.name.split("."):
        kind, at = _field(kind, name, text), at[name]
    if path.percentile:
        if not isinstance(kind, T.StructType) or path.percentile not in kind.names:
            raise ValueError(f"{text}: {path.block}.{path.name} is no ensemble's block")
        at = at[path.percentile]
    return at


def flattened(documents: DataFrame, depth: int = 8) -> DataFrame:
    """documents: id, json. Every node below the root: id, path (array of keys, of an array its places), kind and text; objects and arrays have the text `OBJECT`. Below `depth` a node is told whole, as JSON."""
    spark = documents.sparkSession
    now = documents.select("id", F.array().cast("array<string>").alias("path"), F.try_parse_json("json").alias("v"))
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    number = F.schema_of_variant("v").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    levels = []
    for k in range(depth):
        now = spark.sql("select d.id, array_append(d.path, coalesce(t.key, cast(t.pos as string))) as path, t.value as v from {d} d, lateral variant_explode(d.v) t", d=now)
        last = k == depth - 1
        text = F.when(nested, F.to_json("v") if last else F.lit(OBJECT)).when(number, F.expr("cast(cast(v as double) as string)")).otherwise(F.expr("cast(v as string)"))
        kind = F.when(nested, "object").when(number, "number").otherwise(F.lower(F.schema_of_variant("v")))
        levels.append(now.select("id", "path", kind.alias("kind"), F.coalesce(text, F.lit("null")).alias("text")))
        now = now.where(nested)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


class _Number(str):
    """A number as it is written; the doubles decide whether two are equal."""

    __slots__ = ()


def _number(text: str) -> _Number:
    if len(text) > 1000:  # as the JSON parser of `flattened`
        raise ValueError("a number too long")
    return _Number(text)


def _clean(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _object(pairs: list) -> dict:
    out = {_clean(k): v for k, v in pairs}
    if len(out) < len(pairs):
        raise ValueError("a key twice")
    return out


def _refuse(text: str):
    raise ValueError(text)


_READER = json.JSONDecoder(object_pairs_hook=_object, parse_int=_number, parse_float=_number, parse_constant=_refuse)
_NOTHING = object()


def _nested(nodes: list) -> list:
    return [x for x in nodes if isinstance(x, (dict, list))]


def _read(text: str | None):
    """The document; none if it cannot be read, or has more than a thousand levels, as in `flattened`."""
    try:
        x = _READER.raw_decode(text.lstrip(" \t\n\r"))[0] if text else None
    except (ValueError, RecursionError):
        return None
    if text and text.count("{") + text.count("[") > 1000:
        level = _nested([x])
        for _ in range(1000):
            level = _nested([v for y in level for v in (y.values() if isinstance(y, dict) else y)])
        return None if level else x
    return x


def _written(x) -> str:
    if isinstance(x, dict):
        return "{" + ",".join([f"{json.dumps(k)}:{_written(v)}" for k, v in x.items()]) + "}"
    if isinstance(x, list):
        return "[" + ",".join([_written(v) for v in x]) + "]"
    return x if type(x) is _Number else json.dumps(x)


def _told(x, whole: bool) -> tuple | None:
    """Kind, text and number."""
    if x is _NOTHING:
        return None
    if isinstance(x, (dict, list)):
        return ("json", _written(x), None) if whole else ("object", OBJECT, None)
    if type(x) is _Number:
        return ("number", None, float(x) if "e" in x.lower() else float(x) + 0.0)
    return ("string", _clean(x), None) if isinstance(x, str) else ("void", "null", None) if x is None else ("boolean", "true" if x else "false", None)


def _apart(a, b, depth: int, path: tuple = ()) -> tuple[list[tuple], bool]:
    """Places in order where two documents may differ, up to the first that surely does, and whether there is such a one. Not sure are those at the depth's end, whose JSON is compared as `flattened` tells it."""
    a, b = (x if isinstance(x, dict) else {str(i): v for i, v in enumerate(x)} if isinstance(x, list) else {} for x in (a, b))
    found: list[tuple] = []
    for key in sorted({*a, *b}):
        x, y, here = a.get(key, _NOTHING), b.get(key, _NOTHING), (*path, key)
        both = isinstance(x, (dict, list)) and isinstance(y, (dict, list))
        if both and depth > 1:
            more, sure = _apart(x, y, depth - 1, here)
            found += more
        else:
            left, right = _told(x, depth == 1), _told(y, depth == 1)
            sure = not both and repr(left) != repr(right)  # by repr -0.0 is not 0.0
            if both or sure:
                found.append((".".join(here), left, right))
        if sure:
            return found, True
    return found, False


def first_differences(pairs: DataFrame, depth: int = 8) -> DataFrame:
    """pairs: id (unique), a, b (JSON). For each pair that differs the first path, keys in order at every level, and what stands there (`undefined` where there is nothing). Equal numbers are equal however they are written.

    Both documents are in one row and are walked together, so nothing is shuffled and no node of `flattened` becomes a row. Numbers and what stands below the depth are spelled by Spark.
    """
    kind = pairs.schema["id"].dataType
    node = pa.struct([("kind", pa.string()), ("text", pa.string()), ("number", pa.float64())])
    told = pa.struct([("path", pa.string()), ("a", node), ("b", node)])

    def walk(batches):
        sys.setrecursionlimit(20_000)
        for batch in batches:
            found = [_apart(_read(a), _read(b), depth)[0] for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            values = pa.array([[dict(zip(("path", "a", "b"), (p, *({"kind": x[0], "text": x[1], "number": x[2]} if x else None for x in (a, b))), strict=True)) for p, a, b in f] for f in found], pa.list_(told))
            yield pa.RecordBatch.from_arrays([batch.column("id"), values], ["id", "found"])

    spelled = lambda x: F.when(x.isNotNull(), F.struct(x["kind"].alias("kind"), F.when(x["kind"] == "number", x["number"].cast("string")).when(x["kind"] == "json", F.to_json(F.try_parse_json(x["text"]))).otherwise(x["text"]).alias("text")))
    one = "struct<kind:string,text:string,number:double>"
    found = pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select("id", "a", "b").mapInArrow(walk, f"id {kind.simpleString()}, found array<struct<path:string,a:{one},b:{one}>>")
    apart = F.filter(F.transform("found", lambda x: F.struct(x["path"].alias("path"), spelled(x["a"]).alias("a"), spelled(x["b"]).alias("b"))), lambda x: ~x["a"].eqNullSafe(x["b"]))
    first = found.select("id", F.explode(F.slice(apart, 1, 1)).alias("d"))
    shown = lambda c: F.coalesce(F.col(f"d.{c}.text"), F.lit("undefined")).alias(c)
    return first.select("id", "d.path", shown("a"), shown("b"))
