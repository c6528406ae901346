"""Gridded model files: GRIB2 with simple packing, read as rows of (field, site, value), and their .idx sidecars.

A task reads whole files (`binaryFile`), walks the sections, and decodes nothing but the grid points of the sites: with
simple packing a point's bits stand at a known place, so a field of millions of points costs a few bytes a site.
Sites and their grid indices are small and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grids
from .grids import _signed, _unsigned

FIELDS = "path string, field int, reference_time timestamp, discipline int, category int, parameter int, forecast_hours int, surface int, level double, member int, grid_points int, site_id string, distance_m double, value double"


def messages(data: bytes) -> Iterator[bytes]:
    """The messages of a file; anything between them, or a length beyond the end, is an error."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"GRIB" or data[at + 7] != 2:
            raise ValueError(f"no GRIB2 message at byte {at}")
        n = _unsigned(data[at + 8 : at + 16])
        if n < 20 or at + n > len(data) or data[at + n - 4 : at + n] != b"7777":
            raise ValueError(f"truncated message at byte {at}")
        yield data[at : at + n]
        at += n


@dataclass
class Field:
    head: dict
    grid: bytes
    packing: bytes
    bitmap: bytes | None
    data: bytes

    @property
    def points(self) -> int:
        return _unsigned(self.grid[6:10])


def fields(message: bytes) -> Iterator[Field]:
    """One field for each data section; sections before it carry over, also a bitmap that says so."""
    head = {"discipline": message[6]}
    grid = packing = b""
    bitmap: bytes | None = None
    at = 16
    while message[at : at + 4] != b"7777":
        n, number = _unsigned(message[at : at + 4]), message[at + 4]
        s = message[at : at + n]
        if number == 1:
            year, (month, day, hour, minute, second) = _unsigned(s[12:14]), s[14:19]
            head["reference_time"] = f"{year:04}-{month:02}-{day:02}T{hour:02}:{minute:02}:{second:02}"
        elif number == 3:
            grid = s
        elif number == 4:
            template = _unsigned(s[7:9])
            if template not in (0, 1, 8, 11):
                raise ValueError(f"product template {template}")
            scale, value = _signed(s[23:24]), _signed(s[24:28])
            hours = {0: 1 / 60, 1: 1, 2: 24, 10: 3, 11: 6, 12: 12}.get(s[17], 1) * _unsigned(s[18:22])
            head |= {"category": s[9], "parameter": s[10], "forecast_hours": int(hours), "surface": s[22], "level": value / 10.0**scale, "member": s[35] if template in (1, 11) else None}
        elif number == 5:
            packing = s
        elif number == 6:
            if s[5] == 0:
                bitmap = s[6:]
            elif s[5] == 255:
                bitmap = None
            elif s[5] != 254:
                raise ValueError(f"bitmap indicator {s[5]}")
        elif number == 7:
            yield Field(dict(head), grid, packing, bitmap, s[5:])
        at += n


def scale_factor(base: int, exponent: int) -> float:
    """base^exponent by repeated multiplication or division: the same double on every platform."""
    x = 1.0
    for _ in range(abs(exponent)):
        x = x * base if exponent > 0 else x / base
    return x


def sample(f: Field, indices: list[int]) -> list[float | None]:
    """(X * 2^E + R) * 10^-D at the given points; null where the bitmap has none."""
    template = _unsigned(f.packing[9:11])
    if template != 0:
        raise ValueError(f"data representation {template} is not simple packing")
    import struct

    r = struct.unpack(">f", f.packing[11:15])[0]
    e, d, bits = _signed(f.packing[15:17]), _signed(f.packing[17:19]), f.packing[19]
    two, ten = scale_factor(2, e), scale_factor(10, -d)
    if f.bitmap is not None:  # a point's place among the present ones: bits set before it
        present = np.unpackbits(np.frombuffer(f.bitmap, np.uint8, max(indices, default=0) // 8 + 1))
        before = np.cumsum(present) - present
    out: list[float | None] = []
    for i in indices:
        place = i
        if f.bitmap is not None:
            if not present[i]:
                out.append(None)
                continue
            place = int(before[i])
        if bits == 0:
            out.append(r * ten)
            continue
        first = place * bits
        part = f.data[first // 8 : (first + bits + 7) // 8]
        x = _unsigned(part) >> (-(first + bits) % 8) & ((1 << bits) - 1)
        out.append((x * two + r) * ten)
    return out


def nearest_points(grid: bytes, sites: list[tuple[str, float, float]]) -> list[tuple[int, float]]:
    """Index and distance of the grid point nearest each site."""
    index, far = grids.nearest(grids.grid_of(grid), np.array([s[1] for s in sites], float), np.array([s[2] for s in sites], float))
    return list(zip(index.tolist(), far.tolist(), strict=True))


def sample_files(spark, path: str, sites: list[tuple[str, float, float]]) -> DataFrame:
    """One row for each file, field and site (site_id, latitude, longitude)."""

    def run(batches):
        import datetime

        known: dict[bytes, list[tuple[int, float]]] = {}
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = []
                for k, f in enumerate(x for m in messages(content) for x in fields(m)):
                    at = known.setdefault(f.grid, None) or nearest_points(f.grid, sites)
                    known[f.grid] = at
                    values = sample(f, [i for i, _ in at])
                    when = datetime.datetime.fromisoformat(f.head["reference_time"] + "+00:00")
                    for (site, _, _), (_, far), v in zip(sites, at, values, strict=True):
                        h = f.head
                        rows.append({"path": name, "field": k, "reference_time": when, "discipline": h["discipline"], "category": h["category"], "parameter": h["parameter"], "forecast_hours": h["forecast_hours"], "surface": h["surface"], "level": h["level"], "member": h["member"], "grid_points": f.points, "site_id": site, "distance_m": far, "value": v})
                kinds = [pa.string(), pa.int32(), pa.timestamp("us", "UTC"), *[pa.int32()] * 5, pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], t) for c, t in zip(FIELDS.split(", "), kinds, strict=True)]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)


def within(samples: DataFrame, most_m: float) -> DataFrame:
    """samples, whose read fails if a site lies further from the grid than the model's domain allows."""
    far = F.raise_error(F.concat(F.lit("outside the model's domain: "), F.col("site_id"))).cast("double")
    return samples.withColumn("value", F.when(F.col("distance_m") > most_m, far).otherwise(F.col("value")))


def sidecar(lines: DataFrame) -> DataFrame:
    """lines: path, line_no, line (record:offset:date:variable:level:forecast[:qualifier...]). A record ends where the next one with a larger offset begins; the last has no end."""
    p = F.split("line", ":")
    x = lines.where("length(trim(line)) > 0").select("path", "line_no", p[1].cast("long").alias("start"), p[3].alias("variable"), p[4].alias("level"), p[5].alias("forecast"), F.array_join(F.filter(F.slice(p, 7, 99), lambda q: q != ""), ":").alias("qualifier"))
    w = Window.partitionBy("path").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    return x.withColumn("end", F.min("start").over(w) - 1)


def record(index: DataFrame, variable: str, level: str, forecast: str, qualifier: str | None = None) -> DataFrame:
    """Per file the first record with these keys."""
    hit = (F.col("variable") == variable) & (F.col("level") == level) & (F.col("forecast") == forecast)
    hit = hit if qualifier is None else hit & (F.col("qualifier") == qualifier)
    return index.where(hit).groupBy("path").agg(F.min_by(F.struct("start", "end", "variable", "qualifier"), "line_no").alias("r")).select("path", "r.*")


def byte_range(start: Column, end: Column) -> Column:
    return F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), F.coalesce(end.cast("string"), F.lit("")))
