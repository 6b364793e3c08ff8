"""The driver's contract: queries against their SQL, with and without the training-data subpackage."""

from __future__ import annotations

import decimal
import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from codicil import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The size at which queries are held to their SQL: some faults are rarer than the smallest table has rows.
OWN = os.environ.get("TEST_OWN_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{OWN}/{t}.parquet'")
    return con


def plain(v):
    return int(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_is_its_sql(spark, db, name):
    df = own.QUERIES[name](spark, OWN)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.sql(own.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text"]


def test_every_query_with_sql_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.QUERIES) == set(own.ORACLES)


def test_the_rest_stands_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for f in glob.glob(f"{root}/*.py"):
        shutil.copy(f, tmp_path)
    shutil.copytree(f"{root}/codicil", tmp_path / "codicil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):  # with the pipeline's file left over, then without
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
