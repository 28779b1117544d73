"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from panelwright.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def key(df: pd.DataFrame, cols: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        return f"{float(v) + 0.0:.9g}" if isinstance(v, int | float) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "fi" else str(v)

    return sorted(tuple(plain(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(ORACLE_SQL[name]).fetch_df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert key(got, cols) == key(want, cols)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_nothing_outside_imports_the_text_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1]
    files = [p for p in (root / "panelwright").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert files and not [p for p in files if "panelwright.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
