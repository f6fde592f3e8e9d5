import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def absent(_):
    try:
        import geolattice
    except ModuleNotFoundError:
        return [1]
    return [0]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [1]
sys.path.insert(0, sys.argv[1])  # from here on the driver has the package, the workers don't
import __spark_entry__ as e
q = e.queries()
for name in sorted(n for n in q if n.startswith("op") and n[2].isdigit()):
    q[name](spark, sys.argv[2]).count()
assert not e._training_data() or len([n for n in q if n.startswith("op") and n[2].isdigit()]) == 10
print("all ran")
"""


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_workers_need_no_copy_of_the_package(tmp_path):
    root = Path(__file__).parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", CODE, str(root), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
