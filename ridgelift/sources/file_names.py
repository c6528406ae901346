"""File names of feeds as grammars: one template writes a name from a run, an hour and a variable, and reads them back from it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that public feeds give their files. A field is {name}, or {name:3} for a number of three digits or more.
TEMPLATES = {
    "grid": "{date}T{run:2}Z_{prefix}_{variable}_{grid}_PT{hour:3}H.grib2",
    "west": "CMC_hrdps_west_{variable}_rotated_latlon0.009x0.009_{date}T{run:2}Z_P{hour:3}-00.grib2",
    "members": "CMC_geps-raw_{variable}_latlon0p5x0p5_{date}{run:2}_P{hour:3}_allmbrs.grib2",
    "hrrr": "hrrr.{date}/conus/hrrr.t{run:2}z.wrfprsf{hour:2}.grib2",
    "nam": "nam.{date}/nam.t{run:2}z.{variable}{hour:2}.tm00.grib2",
    "rrfs": "rrfs.{date}/{run:2}/rrfs.t{run:2}z.{variable}.3km.f{hour:3}.conus.grib2",
}
FIELD = re.compile(r"\{(\w+)(?::(\d))?\}")
#: What a field may hold, if not digits.
SHAPES = {"date": r"\d{8}", "prefix": r"[A-Z]+_[A-Z]+", "grid": r"[A-Za-z0-9.]+"}


def file_name(template: str, reference_time: Column, hour: Column, **fields: Column) -> Column:
    """The name of a run's file; reference_time in UTC."""
    known = {"date": F.date_format(reference_time, "yyyyMMdd"), "run": F.date_format(reference_time, "HH"), "hour": hour.cast("string")} | fields
    parts, at = [], 0
    for m in FIELD.finditer(TEMPLATES[template]):
        if m[1] not in known:
            raise ValueError(f"a name of {template} needs {m[1]}")
        value = known[m[1]]
        parts += [F.lit(TEMPLATES[template][at : m.start()]), F.when(F.length(value) < int(m[2]), F.lpad(value, int(m[2]), "0")).otherwise(value) if m[2] else value]
        at = m.end()
    return F.concat(*parts, F.lit(TEMPLATES[template][at:]))


def read_name(template: str, name: Column) -> Column:
    """reference_time, hour, and the other fields of a name, or null for a name of another kind. A field that stands twice must say the same twice."""
    pattern, groups, at = "^", {}, 0
    for m in FIELD.finditer(TEMPLATES[template]):
        pattern += re.escape(TEMPLATES[template][at : m.start()])
        if m[1] in groups:
            pattern += rf"\{groups[m[1]]}"
        else:
            groups[m[1]] = len(groups) + 1
            pattern += f"({rf'\d{{{m[2]},}}' if m[2] else SHAPES.get(m[1], r'[A-Za-z0-9_.-]+?')})"
        at = m.end()
    pattern += re.escape(TEMPLATES[template][at:]) + "$"
    part = lambda f: F.regexp_extract(name, pattern, groups[f])
    when = F.try_to_timestamp(F.concat(part("date"), F.substring(part("run"), 1, 2)), F.lit("yyyyMMddHH"))
    others = [part(f).alias(f) for f in groups if f not in ("date", "run", "hour")]
    return F.when(name.rlike(pattern) & when.isNotNull(), F.struct(when.alias("reference_time"), part("hour").cast("int").alias("hour"), *others))
