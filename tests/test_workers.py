import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from cuewright.providers import FakeTranslator, translate
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = s.createDataFrame([(0, 0, 0.0, 1.0, "a")], "media_id long, idx long, start double, end double, text string")
print("GOT", translate(df, FakeTranslator, pause=0.0).first().text)
"""


def test_workers_need_no_path_of_their_own(tmp_path):
    """Only the driver's Python knows where the package is; the workers start elsewhere."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "GOT [x] a" in out.stdout, out.stderr[-2000:]
