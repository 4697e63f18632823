"""Every registered engine query against its SQL on the unsharded tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from shardloom import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    def plain(v):
        return None if pd.isna(v) else round(v, 6) if isinstance(v, float) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    got = queries.queries()[name](spark, SF).toPandas()
    if name in queries.oracle_sql():
        expected = con.sql(queries.oracle_sql()[name]).df()
        assert sorted(got) == sorted(expected) and rows(got) == rows(expected)
    else:
        assert len(got)


def test_entry_without_the_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/shardloom", tmp_path / "shardloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr
