"""Workers need no copy of the package: queries run from a folder where it cannot be imported."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.append({repo!r})
from vigil.llm.queries import QUERIES
from vigil.session import local_session

spark = local_session(4, shuffle_partitions=4)

def absent(_):
    import importlib.util
    yield importlib.util.find_spec("vigil") is None

assert spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [True]
for name, query in QUERIES.items():
    print(name, query(spark, {sf!r}).count(), flush=True)
"""


def test_every_query_runs_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=REPO, sf="/root/testdata/sf0.001")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.splitlines()) >= 13
