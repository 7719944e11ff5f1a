"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from codexweave.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return str(value) if isinstance(value, (list, dict)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    told = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
