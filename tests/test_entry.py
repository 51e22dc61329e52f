"""The driver contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bytewright import queries as engine

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.QUERIES) <= set(entry.queries())


def test_entry_without_the_other_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "bytewright"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[0] == str(len(engine.QUERIES))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = engine.QUERIES[name](spark, str(DATA))
    wanted = con.sql(engine.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    rows = wanted.fetchall()
    order = [wanted.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in rows)
