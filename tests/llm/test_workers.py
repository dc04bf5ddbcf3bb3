"""Queries on executors that do not have this repository on their path."""

import os
import subprocess
import sys
from pathlib import Path

from tests.llm.test_pipeline import write_tables

HERE = Path(__file__).parent.parent.parent

CODE = """
import sys
sys.path.insert(0, sys.argv[1])  # of the driver alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
import corpus_pipeline
from verbena.llm.queries import QUERIES
for name, run in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
    print("ran", name, run(spark, sys.argv[2]).count() > 0)
def found(_):
    import importlib.util
    yield importlib.util.find_spec("verbena") is not None
print("on the workers:", spark.sparkContext.parallelize([1], 1).mapPartitions(found).collect())
"""


def test_every_query_without_the_package_on_the_workers(spark, tmp_path):
    folder = tmp_path / "tables"
    write_tables(spark, str(folder))
    spark.createDataFrame([(k, f"http://h{k % 3}.example.com/en/{k}", "<p>x</p>") for k in range(20)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(k, [float(k % 4), 1.0, 2.0], 0) for k in range(20)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(HERE), str(folder)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert done.stdout.count("True") == 11 and "on the workers: [False]" in done.stdout
