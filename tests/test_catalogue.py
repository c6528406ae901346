"""Every query with an SQL twin gives the same rows in both engines."""

import math
from pathlib import Path

import duckdb
import pytest

from ridgelift.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    def canon(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0).removesuffix(".0")
        return str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.collect()
    spark.catalog.clearCache()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())
