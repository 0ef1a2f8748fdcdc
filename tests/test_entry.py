import subprocess
import sys
from pathlib import Path

ENTRY = Path(__file__).resolve().parent.parent / "__spark_entry__.py"

SCRIPT = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {entry!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert module.entry(spark).count() > 0
assert module.queries()["similarity_topk"](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


def test_entry_runs_where_workers_cannot_import_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(entry=str(ENTRY)))
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
