"""Text queries against their SQL in DuckDB, where SQL can state them."""

import os

import duckdb
import pytest

from panelwright.llm.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def plain(v):
    return float(f"{v:.12g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.execute(ORACLE_SQL[name])
    assert cols == sorted(d[0] for d in want.description)
    place = [[d[0] for d in want.description].index(c) for c in cols]
    rows = lambda found: sorted(map(repr, ([plain(v) for v in r] for r in found)))
    assert rows([r[c] for c in cols] for r in got.collect()) == rows([r[k] for k in place] for r in want.fetchall())
