"""Analyses of hours by kinds of findings and by extensions of the caller, planned over one frame; and the comparison that follows from the same frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compare, findings
from .texts import KINDS, every_finding

Extractor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Extension:
    """name: owner/kind. extract: (hours, findings) -> a frame with profile_id; each of its rows is a statement."""

    name: str
    extract: Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Analysis:
    hours: DataFrame
    findings: DataFrame  # profile_id, kind, kind_order, finding (JSON)
    extensions: DataFrame  # profile_id, name, statement (JSON)

    def close(self) -> None:
        self.hours.unpersist()


def checked(extensions: Sequence[Extension]) -> None:
    """Refuses names that are not owner/kind, that come twice, or whose kind is one of the built-in ones."""
    for x in extensions:
        owner, slash, kind = x.name.partition("/")
        if not (owner and slash and kind) or kind in KINDS:
            raise ValueError(f"{x.name} is no name for an extension: owner/kind, with a kind of its own")
    names = [x.name for x in extensions]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"extensions given twice: {', '.join(twice)}")


def analyse(hours: DataFrame, kinds: dict[str, Extractor], extensions: Sequence[Extension] = ()) -> Analysis:
    """Runs the extractors of built-in kinds, then the extensions, over one evaluation of the hours, which executors keep until the analysis is closed. Names are checked before anything runs; an extension
    that fails, or whose frame has no profile_id, fails the analysis. What extensions state is kept apart from the findings.
    """
    checked(extensions)
    frame = hours.persist(StorageLevel.MEMORY_AND_DISK)
    found = every_finding({k: extract(frame) for k, extract in kinds.items()})
    stated = []
    for x in extensions:
        rows = x.extract(frame, found)
        if "profile_id" not in rows.columns:
            raise ValueError(f"{x.name}: its rows have no profile_id")
        stated.append(rows.select("profile_id", F.lit(x.name).alias("name"), F.to_json(F.struct(*[c for c in rows.columns if c != "profile_id"])).alias("statement")))
    nothing = found.select("profile_id", F.lit("").alias("name"), F.lit("").alias("statement")).limit(0)
    return Analysis(frame, found, reduce(DataFrame.unionByName, stated, nothing) if stated else nothing)


def analyse_then_compare(hours: DataFrame, place: Callable[[DataFrame], DataFrame], zone: str) -> dict[str, DataFrame]:
    """Votes and board of the members of each site, from one evaluation of the hours. place: adds site and member to a frame with profile_id."""
    h = hours.persist(StorageLevel.MEMORY_AND_DISK)
    covered = place(h).select("site", "member", "day").distinct()
    touched = findings.window_hours(h).select("profile_id", "window_id", "day").distinct()
    windows = place(touched.join(findings.thermal_windows(h).withColumnRenamed("day", "own_day"), ["profile_id", "window_id"]))
    quiet, benches = place(findings.quiet_days(h)), compare.benched(place(findings.terrain_mismatch(h)))
    return {"agreement": compare.window_agreement(covered, windows, quiet, benches=benches), "board": compare.board(covered, windows, quiet, benches, zone)}
