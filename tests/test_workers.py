"""Python workers find the package when the driver runs elsewhere and PYTHONPATH is not set."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from photonloom.session import build_session
spark = build_session("local[2]", 2)
print("rows", entry.queries()["j11_nearest_neighbours"](spark, "/root/testdata/sf0.001").count())
"""


def test_package_reaches_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
