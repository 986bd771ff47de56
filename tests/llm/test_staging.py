"""The package reaches Python workers that cannot import it themselves."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pitchloom.session import build_session
import __spark_entry__ as entry
spark = build_session("local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": sys.argv[1], "spark.driver.memory": "2g"}})
for name in ("op10_bpe_encoding", "op6_language_id", "op1_warc_bundles"):
    print(name, entry.queries()[name](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_queries_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "scratch")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert len(run.stdout.split("\n")) >= 3
