"""The driver contract: names, and the entry without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"


def names(folder):
    out = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120,
                         env=os.environ | {"PYTHONPATH": folder})
    assert out.returncode == 0, out.stderr
    return out.stdout


def test_entry_without_the_optional_operators(tmp_path):
    shutil.copytree(f"{ROOT}/ctxspark", tmp_path / "ctxspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    bare = names(str(tmp_path))
    assert "a1_column_stats" in bare and "op1_" not in bare and "pipeline" not in bare and bare.rstrip().endswith("[]")
    (tmp_path / "ctxspark" / "llm").mkdir()              # an empty folder is no package either
    assert names(str(tmp_path)) == bare


def test_entry_without_a_package_that_the_optional_operators_need(tmp_path):
    shutil.copytree(f"{ROOT}/ctxspark", tmp_path / "ctxspark", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if not (tmp_path / "ctxspark" / "llm").exists():
        return
    (tmp_path / "ctxspark" / "llm" / "queries.py").write_text("import a_package_that_is_not_there\n")
    assert "a1_column_stats" in names(str(tmp_path)) and "op1_" not in names(str(tmp_path))
    (tmp_path / "ctxspark" / "llm" / "queries.py").write_text("from ctxspark.llm import gone_module\nimport ctxspark.llm.gone\n")
    out = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                         env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode != 0 and "gone" in out.stderr


def test_every_oracle_has_its_query():
    assert names(ROOT).rstrip().endswith("[]")
