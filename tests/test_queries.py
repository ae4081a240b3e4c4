"""Every registered query with SQL gives the same rows in DuckDB; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry  # registers all queries
from shoreline import queries as catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].astype(str)
        elif str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


#: Whole runs, whose plans tests/coast/test_control.py and test_runs.py hold against plain Python on smaller rasters.
RUNS = {"inundation_run", "exposure_run", "profile_basins"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - RUNS))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    if name in catalogue.ORACLE:
        pd.testing.assert_frame_equal(tidy(got), tidy(duck.sql(catalogue.ORACLE[name]).df()), check_dtype=False)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(tmp_path):
    """With shoreline/llm and tests/llm deleted the entry point, its queries and the other modules still work."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache", ".hypothesis"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'inundation_frequency' in q and not any(k.startswith('op') for k in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    assert done.returncode == 0, done.stderr
