"""The library stands without the subpackage for training data."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_imports_the_subpackage():
    sources = [p for p in (ROOT / "lectern").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert not [p for p in sources if "lectern.llm" in p.read_text(encoding="utf-8")]


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [n for n in q if n[1:2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
