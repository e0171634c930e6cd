"""The registry of queries without the text problems."""

from __future__ import annotations

import subprocess
import sys

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "siftbed.llm":
            raise ModuleNotFoundError("No module named 'siftbed.llm'", name="siftbed.llm")
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert "p4_found" in names and "scan_findings" in names and "p1_found" not in names, names
assert set(entry.oracle_sql()) <= names
"""


def test_the_rest_works_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", WITHOUT], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).parent.parent / "siftbed"
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and "siftbed.llm" in p.read_text()]
    assert not users
