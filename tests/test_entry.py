"""The entry keeps its own queries where the optional subpackage cannot be imported."""
import subprocess
import sys
from pathlib import Path

_HIDE = """
import sys
sys.modules["regex"] = None
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 200 and "tc_04_reconstruction" in names
assert not any(n.startswith("op1_") for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= set(names)
"""


def test_a_missing_library_costs_only_the_optional_queries():
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", _HIDE], cwd=root, check=True, timeout=120)
