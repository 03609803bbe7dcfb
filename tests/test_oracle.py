"""Every trajectory query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from compare import same_rows

from trajspark.plans.queries import ORACLE_SQL, QUERIES


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {p.stem} as select * from '{p}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())
