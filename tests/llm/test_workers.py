"""Every query of the subpackage on workers that can't import the package: they start in an empty folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tests.test_oracles import SF

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def there(batches):
    import importlib.util
    for b in batches:
        yield b.assign(there=importlib.util.find_spec("folioscope") is not None)[["there"]]

assert not spark.range(1).mapInPandas(there, "there boolean").first()["there"]
import __spark_entry__
queries = __spark_entry__.queries()
for name in [k for k in queries if k.startswith("op") or k == "pipeline"]:
    print(name, queries[name](spark, sys.argv[2]).count(), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_run_without_the_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN, str(Path(__file__).resolve().parents[2]), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = dict(line.split() for line in out.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert out.returncode == 0, out.stderr[-2000:]
    assert len(rows) == 14 and all(int(n) > 0 for n in rows.values())
