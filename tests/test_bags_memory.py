"""Term counts of records: what a task holds follows the text at hand, not the records of a batch."""

import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import types as T

from corvane.functions.text import tokens_of
from corvane.operators import lexical


class Taken:
    """A frame whose step is caught instead of run."""

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, T.StructType([T.StructField(c, t) for c, t in (("id", T.LongType()), ("kb", T.StringType()), ("text", T.StringType()), ("title", T.StringType()))])

    def mapInArrow(self, run, _):
        return run


def batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["all"] * n, pa.string()), pa.array(texts, pa.string()), pa.array([""] * n, pa.string())], names=["id", "kb", "text", "title"])


def test_memory_of_a_task_is_bounded(spark):
    whole = batch([" ".join(f"w{(i * 7 + j) % 90_000}" for j in range(300)) for i in range(6_000)])
    run = lexical.bags(Taken(spark))
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([whole])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 6_000
    assert peak < 40  # 127 MB where a batch's terms were held at once


def test_every_record_is_counted_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TEXT_BYTES", 20)
    texts = ["a b a", None, "", "c " * 50, "d", "e f", "g" * 30, "é è é", None]
    run = lexical.bags(Taken(spark))
    out = [r for b in run(iter([batch(texts), batch([]), batch(texts[:2])])) for r in b.to_pylist()]
    assert [r["id"] for r in out] == [*range(len(texts)), 0, 1]
    assert [dict(zip(r["terms"], r["tfs"], strict=True)) for r in out] == [Counter(tokens_of(t)) for t in [*texts, *texts[:2]]]
    assert [r["dl"] for r in out] == [len(tokens_of(t)) for t in [*texts, *texts[:2]]]
