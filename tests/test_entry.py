"""The driver contract without the package for training data."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline'), len(e.oracle_sql()) > 100)"


@pytest.mark.parametrize("left_over", [False, True])
def test_the_rest_works_without_the_package(tmp_path, left_over):
    shutil.copytree(ROOT / "stratusqc", tmp_path / "stratusqc", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left_over:
        (tmp_path / "stratusqc" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split("\n")[-2] == "[] True", done.stderr
