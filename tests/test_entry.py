"""The entry works without the optional text package, and hides no other failure."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"


@pytest.fixture
def copy(tmp_path):
    for name in ("stockrisk", "oracle"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def imported(folder):
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120, check=False)


def test_the_entry_without_the_text_package(copy):
    from oracle.sql import ORACLE_SQL
    from stockrisk.plans import catalog

    found = imported(copy)
    assert found.stdout.split() == [str(len(catalog.queries())), str(len(ORACLE_SQL)), "False"], found.stderr


def test_a_broken_text_package_is_not_hidden(copy):
    (copy / "stockrisk" / "llm").mkdir()
    (copy / "stockrisk" / "llm" / "__init__.py").write_text("")
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in imported(copy).stderr
