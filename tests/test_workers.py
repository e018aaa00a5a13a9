"""Python functions reach workers that have neither the package nor a path to it; the shared folder is demanded off local."""

import os
import subprocess
import sys

import pytest

from versify import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from versify.session import local_session
from versify.plans.catalog import QUERIES
spark = local_session(2, 2)
print("NAMES", QUERIES["safe_names"](spark, "/root/testdata/sf0.001").where("filename is not null").count())
"""


def test_python_functions_travel_with_the_job(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "NAMES 50" in out.stdout, out.stderr[-2000:]


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session())
