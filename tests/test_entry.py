"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 60


def test_nothing_else_needs_the_subpackage(tmp_path):
    kept = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=kept)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'institution_kpi' in q and not [n for n in q if n.startswith('op')], q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, check=True)


@pytest.mark.parametrize("left", ["compiled files", "a broken module"])
def test_a_subpackage_that_can_not_be_imported_takes_nothing_down(tmp_path, left):
    kept = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=kept)
    folder = tmp_path / "repo" / "medlar" / "llm"
    (folder / "__pycache__").mkdir(parents=True)
    (folder / "__pycache__" / "queries.cpython-313.pyc").write_bytes(b"x")
    if left == "a broken module":
        (folder / "__init__.py").write_text("")
        (folder / "queries.py").write_text("import a_module_that_is_not_there\n")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, check=True)


def test_entry_on_the_smallest_tables(spark):
    assert contract.entry(spark).count() == 14
