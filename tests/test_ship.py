import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from pyspark.sql import functions as F
from sparkrel.ship import ship
from sparkrel.sources.geometry import parse
ship(spark)
print("parsed", spark.range(1).select(F.udf(lambda i: parse(f"POINT({{i}} 2)").wkt())("id")).first()[0])
"""


def test_workers_get_the_package(tmp_path):
    """The driver alone knows where the package is."""
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "parsed POINT(0 2)" in out.stdout, out.stderr[-2000:]
