"""The driver's entry: it works with and without the corpus operations."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def names(repo):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=repo, capture_output=True, text=True, check=True).stdout
    return [set(line.split()[1:]) for line in out.splitlines() if line.startswith(("NAMES", "SQL"))]


def test_core_stands_alone(tmp_path):
    import shutil

    shutil.copytree(REPO / "kinstats", tmp_path / "kinstats", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    alone, sql = names(tmp_path)
    assert "he_ols" in alone and not any(x.startswith("op") or x == "pipeline" for x in alone) and sql <= alone
    full, _ = names(REPO)
    assert alone <= full


def test_core_stands_beside_a_pipeline_without_its_operations(tmp_path):
    import shutil

    shutil.copytree(REPO / "kinstats", tmp_path / "kinstats", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    alone, _ = names(tmp_path)
    assert "he_ols" in alone and "pipeline" not in alone


def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() == 6 and out.columns[:2] == ["interval", "n_pairs"]
