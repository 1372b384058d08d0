"""Every registered map query runs, and agrees with its SQL in DuckDB."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from roadloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def ordered(frame):
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    got, want = ordered(entry.queries()[name](spark, sf_dir).toPandas()), ordered(duck.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.dtypes.tolist() == want.dtypes.tolist()
    assert got.equals(want), got.compare(want).head() if len(got) == len(want) else (len(got), len(want))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["trajectory_id", "point_index", "cand_rank", "road_id", "distance"]
