"""Every registered graph query against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weftgraph.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return float(f"{v:.9g}") if math.isfinite(v) else str(v)
        return tuple(v) if isinstance(v, list) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*columns).collect()) == plain(duck.sql(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall())
