"""Every query of this subpackage and the pipeline in a folder where only the driver can import the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from termloom.session import local_session
spark = local_session(4, 4, "driver only")
spark.sparkContext.setLogLevel("OFF")
names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
for name in names:
    entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
try:
    spark.range(1).rdd.map(lambda _: __import__("termloom")).collect()
except Exception as e:
    print("absent", "No module named" in str(e))
"""


def test_executors_need_no_copy(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    lines = done.stdout.splitlines()
    assert sum(x.startswith("ran ") for x in lines) == 14 and "absent True" in lines, done.stdout[-500:] + done.stderr[-3000:]
