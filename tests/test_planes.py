"""The retrieval side must not know the ledger, and nothing but the entry point the llm package."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_retrieval_is_free_of_the_ledger():
    for name in ("retrieval", "chunking", "citation"):
        assert not [i for i in imported(ROOT / f"evidentia/operators/{name}.py") if "ledger" in i]


def test_nothing_in_the_library_imports_llm():
    for path in (ROOT / "evidentia").rglob("*.py"):
        if "llm" not in path.parts:
            assert not [i for i in imported(path) if "evidentia.llm" in i], path


def test_entry_loads_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in ("evidentia/llm", "tests/llm"):
        shutil.rmtree(copy / name, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            (copy / gone).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)
