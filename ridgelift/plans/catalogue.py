"""All registered queries of the weather side, with their SQL twins."""

from __future__ import annotations

from . import compare, contracts, findings, forecast, kinds, live, more, paths, places, series, station, texts

MODULES = (station, forecast, findings, kinds, more, compare, live, series, texts, places, paths, contracts)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.R.sql.items()}
