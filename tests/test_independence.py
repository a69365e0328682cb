"""The library must stand without the training-data subpackage."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_it():
    for f in (ROOT / "quaestor").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"quaestor\.llm|from \.+llm|import llm", f.read_text()), f


def test_entry_works_without_it():
    code = "import sys; sys.modules['quaestor.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('p1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
