import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parents[1]
SF = "/root/testdata/sf0.001"


def test_queries_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "collection", "datetime", "end_datetime", "value", "properties"] and df.count() <= 10


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_without_the_training_data_part(tmp_path, left):
    """The rest imports and keeps its queries where that part was taken away, with the pipeline's file or without."""
    for name in ("geolattice", "__spark_entry__.py", *(x for x in left if (ROOT / x).exists())):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "geolattice/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pipeline' not in n and 'search_ids' in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= set(n)"
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_that_part():
    for path in (ROOT / "geolattice").rglob("*.py"):
        if "llm" not in path.parts:
            assert "geolattice.llm" not in path.read_text(), path
