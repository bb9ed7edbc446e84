"""Each query that has SQL gives what DuckDB gives; the others run and keep their columns."""

import pytest

from pointloom.plans.registry import ORACLE_SQL, QUERIES

SF = "sf0.01"


@pytest.fixture(scope="module")
def con(duckdb_at):
    return duckdb_at(SF)


def rows(df, columns):
    return sorted(map(tuple, df[columns].astype(object).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, f"/root/testdata/{SF}").toPandas()
    want = con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(want) > 0
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1818
    assert set(entry.oracle_sql()) <= set(entry.queries())
