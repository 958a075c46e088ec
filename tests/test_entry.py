"""The entry module without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
ASK = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q) > 100, set(o) <= set(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_subpackage(tmp_path, with_pipeline):
    shutil.copytree(f"{ROOT}/sentinelweave", tmp_path / "sentinelweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if with_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True", "[]"], out.stderr
