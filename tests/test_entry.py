"""The driver's entry, with and without the optional subpackage."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("gone", [(), ("tamis/llm", "tests/llm"), ("tamis/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_works_with_what_is_there(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    whole = (copy / "tamis/llm").exists()
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True)
        (copy / name).unlink(missing_ok=True)
    found, sql = json.loads(subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, check=True).stdout)
    own = [q for q in found if q == "pipeline" or q.startswith("op")]
    assert len(own) == (11 if whole and not gone else 0) and len(found) > 100 and set(sql) <= set(found)


def test_nothing_else_imports_the_optional_subpackage():
    for f in [*ROOT.glob("tamis/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in f.parts and f.name not in ("test_entry.py",):
            assert "tamis.llm" not in f.read_text(), f
