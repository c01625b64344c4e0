"""The entry points with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_works_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) == set(q), 1; assert 'run_top500' in q and 'pipeline' not in q"
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr


def test_library_does_not_import_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "postsift")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as file:
                    assert "postsift.llm" not in file.read()
