"""Every query with SQL gives what DuckDB gives on the same files."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from chunkloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="session")
def duck(data: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_all_sql_has_a_query() -> None:
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data: str, tmp_path, name: str) -> None:
    found = QUERIES[name](spark, data)
    found.write.parquet(str(tmp_path / "out"))
    want = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == sorted(found.columns)
    duck.register("want", want)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    got = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'"
    assert duck.sql(f"SELECT {columns} FROM want EXCEPT ALL {got} LIMIT 3").fetchall() == []
    assert duck.sql(f"{got} EXCEPT ALL SELECT {columns} FROM want LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, data: str, name: str) -> None:
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark) -> None:
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
