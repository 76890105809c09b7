"""The entry module with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_corpus_folders(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "__pycache__") or (n == "corpus_pipeline.py" and not pipeline)])
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert "policy_summary" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries()), sorted(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("columns", e.entry(spark).columns)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA")}}, capture_output=True, text=True, timeout=300)
    assert "columns" in done.stdout, done.stderr[-2000:]
