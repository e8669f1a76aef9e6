"""The library and its queries stand without the text operators."""

import ast
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/lumenframe", tmp_path / "lumenframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "lumenframe" / "llm").mkdir()  # what a deletion may leave
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(q.startswith('op1_') for q in e.queries()) and 'pipeline' not in e.queries() and len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(f"{ROOT}/lumenframe"):
        if "/llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(f"{folder}/{name}").read())
                modules = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not any("llm" in m for m in modules), name
