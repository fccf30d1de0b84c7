"""The driver's contract, with and without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and "sum_qty" in df.columns


def test_sql_names_are_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "fedframe", tmp_path / "fedframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
