"""Every query with SQL against DuckDB on the small tables; the others must run."""

import json
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = driver.oracle_sql()


def plain(v):
    if isinstance(v, (float, np.floating)):
        return "null" if np.isnan(v) else f"{v:.6f}"
    if isinstance(v, np.ndarray):
        return json.dumps(v.tolist())
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    got = driver.queries()[name](spark, SMALL).toPandas()
    assert len(got.columns)
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_without_the_optional_part(tmp_path):
    """The rest imports and registers its queries when the optional folders are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(driver.__file__))
    shutil.copytree(os.path.join(root, "lodestone"), tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(driver.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'near_dedup_greedy' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
