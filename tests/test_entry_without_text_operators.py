"""The entry module where the operators for training text are not installed."""

import subprocess
import sys

from conftest import ROOT

BLOCKED = """
import importlib.util, sys
sys.path.insert(0, {root!r})
find = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name.startswith("pulseframe.llm") else find(name, *a)
class Blocked:
    def find_spec(self, name, *a):
        if name.startswith("pulseframe.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
assert set(entry.oracle_sql()) <= set(entry.queries())
print(len(entry.queries()))
"""


def test_entry_imports_without_them():
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(root=ROOT)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 115
