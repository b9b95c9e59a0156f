"""What Python workers keep between tasks."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa

from factloom.llm import jaccard, mixing

KEPT = r'''
import random, re
import pyarrow as pa
from factloom.llm import jaccard

held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


class Caught:
    def mapInArrow(self, run, schema):
        self.run = run


docs = Caught()
jaccard._sets(docs, 5)
rng = random.Random(3)
batches = lambda n, words: (pa.record_batch({"doc": list(range(k, k + 100)), "text": [" ".join(str(rng.random()) for _ in range(words)) for _ in range(100)]}) for k in range(n))
assert sum(b.num_rows for b in docs.run(batches(1, 10))) == 100
before = held()
assert sum(b.num_rows for b in docs.run(batches(6, 2_000))) == 600
print(held() - before)
'''


def test_a_task_leaves_its_worker_as_small_as_it_was():
    out = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=True).stdout
    assert float(out) < 10  # MB


def test_frequent_ngrams_are_counted_by_set():
    class Caught:
        def mapInArrow(self, run, schema):
            self.run = run

    docs = Caught()
    jaccard._sets(docs, 2, chunk=5, common=2)
    texts = ["a b c", "b c d", "A b c", None, "x", "c d e", "a b"]
    rows = [r for b in docs.run(iter([pa.record_batch({"doc": pa.array(range(7), pa.int64()), "text": texts})])) for r in b.to_pylist()]
    assert [(r["doc"], r["n"]) for r in rows if r["gram"] is None] == [(0, 2), (1, 2), (2, 2), (3, 0), (4, 1), (5, 2), (6, 1)]
    grams = {t: int(jaccard.ngrams([t], 2)[0][0]) for t in ("a b", "b c", "c d")}
    assert {r["gram"]: r["times"] for r in rows if r["gram"] is not None} == {grams["a b"]: 2, grams["b c"]: 2, grams["c d"]: 2}


def test_the_drivers_rows_need_no_python_worker(spark):
    sizes = spark.createDataFrame([("b", 10), (None, 30), ("a", 60)], "source string, source_size long")
    told = mixing.targets(sizes, (5, 2, 1), 3)
    assert "ExistingRDD" not in told._jdf.queryExecution().executedPlan().toString()
    assert [f.dataType.simpleString() for f in told.schema] == ["string", "bigint", "double"]
    assert {tuple(r) for r in told.collect()} == {("a", 60, 62.5), ("b", 10, 25.0), (None, 30, 12.5)}
    assert mixing.targets(sizes.where("false"), (5, 2, 1), 3).collect() == []
