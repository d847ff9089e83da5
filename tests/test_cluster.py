"""Queries whose tasks run in other JVMs than the driver's; each in a session of its own, as a process has one master."""

import json
import os
import subprocess
import sys
from pathlib import Path

SF = "/root/testdata/sf0.001"
RUN = """
import json, sys
from pyspark.sql import SparkSession
from tessera.queries import QUERIES
conf = {"spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://" + sys.argv[3]}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
print("rows", json.dumps(sorted(map(list, QUERIES[sys.argv[1]](spark, sys.argv[2]).collect()))))
"""


def on_two_executors(name, at):
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    ran = subprocess.run([sys.executable, "-c", RUN, name, SF, str(at)], env=env, cwd=at, capture_output=True, text=True, timeout=300)
    found = [line for line in ran.stdout.splitlines() if line.startswith("rows ")]
    assert found, ran.stderr[-2000:]
    return json.loads(found[0][5:])


def test_jdbc_tables_are_read_by_other_jvms(spark, tmp_path):
    want = spark.read.parquet(f"{SF}/nation.parquet").where("n_nationkey > 20")
    assert on_two_executors("jdbc_source", tmp_path) == sorted(map(list, want.collect()))
