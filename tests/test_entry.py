"""The library without the text operators: a copy that lacks their folders imports and registers."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PARTS = ["weftgraph/llm", "tests/llm", "corpus_pipeline.py"]


@pytest.mark.parametrize("gone", [PARTS, PARTS[:2], ["corpus_pipeline.py"]])
def test_the_rest_imports_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    skip = {str(ROOT / p) for p in gone} | {str(ROOT / ".git")}
    shutil.copytree(ROOT, copy, ignore=lambda at, names: [
        n for n in names if f"{at}/{n}" in skip or n == "__pycache__"])
    code = ("import __spark_entry__ as e; from weftgraph import catalog; "
            "assert set(catalog.QUERIES) <= set(e.queries()); print(len(e.queries()))")
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout) > 200
