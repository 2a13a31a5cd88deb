"""The library stands without the subpackage for training data."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "needledrop", tmp_path / "needledrop", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'browse_default' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_subpackage():
    for path in ROOT.glob("needledrop/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
