"""The register against DuckDB on the smallest tables, and the entry module without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from loreforge.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    rows = Counter(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows == Counter(repr(r) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_the_llm_subpackage(tmp_path, gone):
    """The two llm folders alone, or the pipeline too, are deleted: the rest imports, lists its queries and runs one."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    code = """
import __spark_entry__ as e
q = e.queries()
assert 'hybrid_search_rrf' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q
assert set(e.oracle_sql()) <= set(q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert q['chapter_list'](spark, '/root/testdata/sf0.001').count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, check=True)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
