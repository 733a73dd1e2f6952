"""The entry without the training-data subpackage, or with what is left of it."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", [False, True])
def test_entry_without_the_subpackage(tmp_path, left):
    shutil.copytree(f"{ROOT}/descra", tmp_path / "descra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left:
        (tmp_path / "descra/llm/__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('QUERIES', len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "QUERIES" in said.stdout, said.stderr
    n, has = said.stdout.split("QUERIES")[1].split()
    assert int(n) >= 45 and has == "False"
