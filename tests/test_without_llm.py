"""The rest of the repository lives without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
queries = entry.queries()
assert len(queries) > 100 and not [q for q in queries if q.startswith("op") or q == "pipeline"], queries
assert set(entry.oracle_sql()) <= set(queries)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.entry(spark).count())
"""


@pytest.mark.parametrize("gone", [["tidemark/llm", "tests/llm"], ["tidemark/llm", "tests/llm", "corpus_pipeline.py"]])
def test_repository_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "rows 150" in out.stdout, out.stderr[-2000:]
