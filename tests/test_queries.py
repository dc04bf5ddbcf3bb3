"""Registered queries against DuckDB, and the driver contract."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from verbena.plans import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HERE = Path(__file__).parent.parent

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(v.isoformat() if hasattr(v, "isoformat") else repr(v) for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), columns)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "n", "qty", "avg_price"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'summarise' in q and not any(k[:2] == 'op' or k == 'pipeline' for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy).returncode == 0
