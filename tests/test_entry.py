import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))


def test_the_library_works_without_the_training_data_package(tmp_path):
    shutil.copytree(os.path.join(ROOT, "textweft"), tmp_path / "textweft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e, textweft.cli, textweft.streaming.incremental; assert 'pair_metrics' in e.queries() and 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="the smallest tables aren't here")
def test_entry(spark):
    first = entry.entry(spark).head(2)
    assert first[0].similarity >= first[1].similarity > 0
