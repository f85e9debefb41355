"""The driver's contract: every query runs, and equals its SQL, over a small set of tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from chronofold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in registry.ORACLES:
        assert got
        return
    cursor = duck.execute(registry.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted((tuple(rounded(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


def test_entry_has_rows(spark):
    assert registry.QUERIES["conversations_rollup"](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    top = Path(entry.__file__).parent
    shutil.copytree(top / "chronofold", tmp_path / "chronofold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op1') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-3:] == [str(len(registry.QUERIES)), "False", "False"]


def test_the_rest_does_not_import_the_corpus_operators():
    top = Path(entry.__file__).parent / "chronofold"
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert "chronofold.llm" not in path.read_text(), path
