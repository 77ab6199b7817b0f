"""What Python workers keep of stages that are over."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: One core has one worker, so what counts its memory is the worker that did the work.
SCRIPT = r"""
import random, re
import pyarrow as pa
from lakekit.llm import quality
from lakekit.session import get_session

def anonymous(batches):
    import numpy, pyarrow.compute
    for batch in batches:
        lines = open("/proc/self/smaps_rollup").read()
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", lines))) >> 10])], ["mb"])

spark = get_session("memory", "local[1]", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"})
held = lambda: spark.range(0, 1, 1, 1).mapInArrow(anonymous, "mb long").first()[0]
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(20000)]
rows = [(i, " ".join(rng.choices(words, k=700))) for i in range(4000)]
docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
before = held()
assert quality.keep(docs).count() == 4000
print("kept", held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux's counts of memory")
def test_a_worker_gives_back_what_a_stage_took():
    path = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=300)
    assert "kept" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split("kept")[1]) < 50


def test_only_texts_go_to_python_for_their_counts(spark):
    from lakekit.llm import quality

    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, other string")
    for frame in (quality.keep(docs), quality.measure(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1 and "MapInArrow" not in plan
