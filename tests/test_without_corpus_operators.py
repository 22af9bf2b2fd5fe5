"""The rest of the library when the corpus operators are deleted, and when one of their imports is broken."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def copy_without(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    return tmp_path / "repo"


def run(code, where):
    return subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, timeout=300, env={"PATH": "/usr/bin:/bin", "HOME": str(where), "PYTHONPATH": ""})


def test_entry_and_quick_tests_without_the_folders(tmp_path):
    where = copy_without(tmp_path)
    out = run("import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in q); "
              "assert set(e.oracle_sql()) <= set(q)", where)
    assert out.returncode == 0, out.stderr
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "--collect-only", "tests"], cwd=where, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stdout


def test_a_broken_import_inside_is_not_swallowed(tmp_path):
    where = copy_without(tmp_path)
    (where / "hitlink/llm").mkdir()
    (where / "hitlink/llm/__init__.py").write_text("")
    (where / "hitlink/llm/queries.py").write_text("import a_wheel_that_is_not_there\nQUERIES = {}\n")
    (where / "corpus_pipeline.py").write_text("ORACLE_SQL = None\ndef run(spark, sf_dir):\n    return None\n")
    out = run("import __spark_entry__ as e; e.queries()", where)
    assert out.returncode != 0 and "a_wheel_that_is_not_there" in out.stderr
