"""Every query with Python functions runs on workers that have neither the package nor a path to it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from versify.session import local_session
from versify.llm.registry import queries
spark = local_session(4, 2)
for name, query in queries().items():
    print("DONE", name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_queries_travel_with_the_job(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.stdout.count("DONE") == 13, out.stdout + out.stderr[-3000:]
