"""Windows of a member that start or end at one instant: the first of them counts, as in the SQL run in one thread; equal spans are lit once."""

import duckdb
import pytest

from ridgelift.plans import catalogue

from .test_catalogue import SF, rows_of


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Three copies of the orders with shifted keys, their days cut to the year and their customers to 25: many windows of a profile share an instant."""
    d = tmp_path_factory.mktemp("tied")
    with duckdb.connect() as c:
        c.execute(f"copy (select * replace (o_orderkey + i * 3000 as o_orderkey, o_custkey % 25 * 10 as o_custkey, date_trunc('year', o_orderdate)::timestamp as o_orderdate) from '{SF}/orders.parquet', range(3) r(i)) to '{d}/orders.parquet' (format parquet)")
        c.execute(f"copy (select * replace (l_orderkey + i * 3000 as l_orderkey) from '{SF}/lineitem.parquet', range(3) r(i)) to '{d}/lineitem.parquet' (format parquet)")
    return str(d)


def assert_same(spark, tied, name, sql):
    df = catalogue.queries()[name](spark, tied)
    got = df.collect()
    spark.catalog.clearCache()
    with duckdb.connect(config={"threads": 1}) as c:
        for t in ("orders", "lineitem"):
            c.execute(f"create view {t} as select * from '{tied}/{t}.parquet'")
        want = c.execute(sql)
        columns = [x[0] for x in want.description]
        assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", ["c04_timing_envelope", "c11_timing_trajectory"])
def test_first_of_equal_edges(spark, tied, name):
    assert_same(spark, tied, name, catalogue.oracle_sql()[name])


def test_no_hour_is_lit_twice(spark, tied):
    """The SQL leaves the order of equal spans to each of two window passes, and may count an hour twice: here each span stands once."""
    sql = catalogue.oracle_sql()["c16_compare_board"]
    assert sql.count("sp as (select site") == 1
    assert_same(spark, tied, "c16_compare_board", sql.replace("sp as (select site", "sp as (select distinct site"))
