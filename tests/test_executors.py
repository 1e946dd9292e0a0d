"""What needs executors apart from the driver: a cluster of JVMs on this machine."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pyspark

ROOT = Path(__file__).resolve().parent.parent
CHILD = """
from pyspark.sql import SparkSession
from larkspur.queries import QUERIES

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.executor.memory", "600m").getOrCreate()
print("rows", sorted((r.n_nationkey, r.n_regionkey) for r in QUERIES["jdbc_table"](spark, "/root/testdata/sf0.001").collect()))
"""


def test_jdbc_table_on_executors(tmp_path):
    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(ROOT)}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    run = subprocess.run([sys.executable, "-c", CHILD], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    t = pq.read_table("/root/testdata/sf0.001/nation.parquet").to_pylist()
    assert f"rows {sorted((r['n_nationkey'], r['n_regionkey']) for r in t)}" in run.stdout, run.stderr[-2000:]
