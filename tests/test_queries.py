"""Every registered query with SQL, against DuckDB on the smallest tables; the others must return rows."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}") if v else 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql()])
def test_fitted_queries_return_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1500


def test_works_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(entry.__file__).parent
    shutil.copytree(repo / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode != 0
    (tmp_path / "corpus_pipeline.py").write_text("from tidemark.llm import mixing")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
