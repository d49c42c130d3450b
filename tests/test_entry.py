"""The entry point with and without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(k.startswith('op1') for k in e.queries()))"


@pytest.mark.parametrize("gone", [("larkspur/llm", "tests/llm", "corpus_pipeline.py"), ("larkspur/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *(g.rsplit("/", 1)[-1] for g in gone)))
    asked = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300, check=True)
    queries, oracles, pipeline, operators = asked.stdout.split()
    assert int(queries) >= int(oracles) > 50 and pipeline == "False" and operators == str("larkspur/llm" not in gone and (ROOT / "larkspur/llm").exists())
