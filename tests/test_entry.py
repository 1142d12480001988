"""The entry module stands without the optional part."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

COUNT = "import __spark_entry__ as e; print(len(e.queries()), 'top_terms' in e.queries(), any(k.startswith('op1_') for k in e.queries()))"


def run(folder, code=COUNT):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


@pytest.fixture()
def copy(tmp_path):
    def skip(_, names):
        return [n for n in names if n in ("__pycache__", "llm", ".git", "tests")]

    shutil.copytree(os.path.join(ROOT, "plume"), tmp_path / "plume", ignore=skip)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    return tmp_path


def test_without_the_part(copy):
    assert run(copy)[1:] == ["True", "False"]


def test_with_a_left_over_cache_folder(copy):
    (copy / "plume" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy) if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) else None
    assert run(copy)[1:] == ["True", "False"]


def test_with_a_missing_module(copy):
    """A third-party module that the part needs cannot be imported."""
    (copy / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    assert run(copy)[1:] == ["True", "False"]
