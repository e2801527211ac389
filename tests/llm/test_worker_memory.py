import subprocess
import sys
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent.parent


def peak_mb(run, batch):
    """What ``run`` takes at most, beside the batch, by numpy's and Python's own count."""
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["quality", "ngram_join"])
def test_texts_are_taken_apart_in_small_chunks(spark, monkeypatch, name):
    import numpy as np

    from tidemark.llm import ngram_join, quality

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    kept = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: kept.append(run))
    if name == "quality":
        r, d = np.random.default_rng(0), len(quality.FEATURES) + quality.BUCKETS
        w = {"W": r.normal(size=(d, 24)), "b": np.zeros(24), "V": r.normal(size=(24, 12)), "U": r.normal(size=(24, 12)), "a": r.normal(size=12), "c": r.normal(size=24), "d": np.zeros(1)}
        quality.with_scores(docs, quality.AttentionModel(np.zeros(d), np.ones(d), w))
    else:
        ngram_join._sketches(docs, 5, 80, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    texts = [" ".join(f"w{i * k % 9973}" for i in range(500)) for k in range(1, 2001)]
    rows, peak = peak_mb(kept[0], pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": texts}))
    assert rows == 2000 and peak < 80  # in chunks of 4 MB: 187 and 131


def test_worker_gives_memory_back_after_a_task():
    code = """
import random, sys
import pyarrow as pa
from pyspark.sql import types as T
from tidemark.llm import bpe

class Docs:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    def mapInArrow(self, run, schema):
        return run

def held():
    return next(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous")) // 1024

def batches():
    r = random.Random(1)
    for _ in range(2):
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [" ".join("".join(r.choices("etaoinshrdlu", k=5)) for _ in range(500)) for _ in range(1000)]})

run = bpe.encode(Docs(), bpe.default_vocabulary(), decoded="decoded")
bpe.vocabulary(bpe.default_vocabulary())
before = held()
rows = sum(x.num_rows for x in run(batches()))
print(rows, held() - before)
"""
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == "2000" and int(out[1]) < 90  # nothing given back: 134
