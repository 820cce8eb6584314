from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    """A copy without the llm folders and the pipeline still imports and lists the index's queries."""
    import shutil

    shutil.copytree(ROOT / "quarrydex", tmp_path / "quarrydex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True)
    assert said.stdout.split() == ["56", "56"], said.stderr
