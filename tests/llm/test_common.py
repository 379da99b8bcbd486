import os
import random
import subprocess
import sys

from factlake.llm.common import connected_components

SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from factlake.llm.common import drop_stored, shared_dir, stored
df = stored(spark.range(5))
assert df.count() == 5 and shared_dir(spark) == shared_dir(spark)
at = shared_dir(spark)
assert len(os.listdir(at)) == 1
drop_stored(spark)
assert not os.listdir(at)
print("fine", at)
"""


def test_a_session_without_a_shared_folder(tmp_path):
    """With no configuration at all, as in a plain local session; the folder goes when the session ends."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    env.pop("SPARK_HOME", None)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], env=env, capture_output=True, text=True, timeout=300)
    line = [x for x in done.stdout.splitlines() if x.startswith("fine ")]
    assert line, done.stderr[-2000:]
    assert not os.path.exists(line[0].removeprefix("fine "))


def test_components(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
