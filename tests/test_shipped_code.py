"""Python workers that don't have this repository on their path."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from shelfspark.plans import catalogue
from shelfspark.operators import search
for name in {names!r}:
    catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()
    print("ran", name, flush=True)
docs = spark.createDataFrame([("1", "running rivers")], "asset_id string, ocr_text string")
assert search.bm25(docs, "river", porter=True).count() == 1
print("ran stems")
"""

NAMES = ["face_clusters", "weekend_runs", "semantic_ann", "diversify"]


def test_each_query_brings_its_code(tmp_path):
    """Each in an application of its own, for the first one ships the code for all."""
    for some in [[n] for n in NAMES] + [[]]:
        script = tmp_path / "run.py"
        script.write_text(SCRIPT.format(root=str(Path(__file__).resolve().parent.parent), names=some))
        done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]
        assert [x for x in done.stdout.splitlines() if x.startswith("ran")] == [f"ran {n}" for n in some] + ["ran stems"]
