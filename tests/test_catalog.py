"""Every query with SQL gives the rows that DuckDB finds."""

import os

import duckdb
import pandas as pd
import pytest

from lodestar.catalog import load

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def text(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["stream_ingest_idempotent", "stream_sliding_windows", "stream_dedup_late"])
def test_stream_of_a_folder(spark, con, name, tmp_path):
    """A table of several part files is read whole."""
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLES[name]).df())
