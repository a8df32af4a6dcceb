"""Python functions and shared folders on executors: a session started elsewhere, and a cluster without a shared folder."""

import os
import subprocess
import sys

import pytest

from encore.session import scratch_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_p_values_from_a_foreign_folder(tmp_path):
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from encore.session import build_session
from encore.functions.tails import chi2_upper_col, t_two_sided_col
spark = build_session("foreign", "2", 2)
row = spark.range(1).selectExpr("3.841458820694124D AS x", "1.0D AS df", "2.0D AS t").select(chi2_upper_col("x", "df").alias("c"), t_two_sided_col("t", "df").alias("t")).first()
assert abs(row.c - 0.05) < 1e-9 and abs(row.t - 0.29516723530086647) < 1e-9, row
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch_folder(Session())


def test_folders_go_with_the_application(tmp_path):
    code = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from encore.session import checkpointed
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", sys.argv[2]).config("spark.ui.enabled", "false").getOrCreate()
df = checkpointed(spark.range(5))
assert df.count() == 5 and len(os.listdir(sys.argv[2])) >= 1
"""
    shared = tmp_path / "shared"
    done = subprocess.run([sys.executable, "-c", code, ROOT, str(shared)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list(shared.glob("encore-*"))
