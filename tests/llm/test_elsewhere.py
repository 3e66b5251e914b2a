"""Queries run where the executors do not have this package: a session started in another folder."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from webquire.session import local_session
spark = local_session(4, "elsewhere")
for name in {names!r}:
    print(name, entry.queries()[name](spark, {sf!r}).count())
"""
NAMES = ("op1_quality_cascade", "op4_warc_chunks", "op8_line_templates", "op11_source_divergence", "op12_impact_search", "op13_periodic_runs")


def test_queries_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    script = SCRIPT.format(root=root, names=NAMES, sf="/root/testdata/sf0.001")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == list(NAMES), done.stderr[-2_000:]
