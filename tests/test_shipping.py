"""Executors whose Python does not find the package where the driver does."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import corpus_pipeline

conf = {"spark.master": "local-cluster[1,2,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": sys.argv[2], "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
docs = spark.read.parquet(sys.argv[3] + "/documents.parquet")
print("rows", corpus_pipeline.quality_classifier_stage(spark, docs, sys.argv[3]).count())
spark.stop()
"""


def test_a_stage_runs_where_executors_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    (tmp_path / "run.py").write_text(RUN)
    said = subprocess.run([sys.executable, "run.py", str(REPO), f"file://{tmp_path}/shared", "/root/testdata/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert said.returncode == 0, said.stderr[-2000:]
    assert 0 < int(said.stdout.split("rows ")[1].split()[0]) <= 1000
