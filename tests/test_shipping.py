"""The package works when the driver is started from any directory."""
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from monthloom.session import local_session
spark = local_session(2, "2g", {{"spark.checkpoint.dir": "file://{shared}"}})
print("rows", entry.queries()["ml_01_elastic_net"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_workers_find_the_package_from_another_directory(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=str(ROOT), shared=str(tmp_path))],
        cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 0
