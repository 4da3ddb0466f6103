"""The exact vector scan: a task's memory doesn't grow with queries times neighbours times dimensions, and results are those of brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corvane.operators import dense


class Taken:
    """A frame whose scan is caught instead of run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    filter = select

    def mapInArrow(self, run, _):
        return run


def scan(spark, x, ids, k):
    run = dense._block(Taken(spark), ids, x[ids], None, k, True)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 2_000)), pa.ListArray.from_arrays(np.arange(2_001, dtype=np.int32) * x.shape[1], x[a : a + 2_000].ravel()), pa.array([""] * 2_000)], names=["id", "v", "scope"]) for a in range(0, len(x), 2_000)]
    tracemalloc.start()
    out = [r for b in run(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] if len(ids) < 10 else [b.num_rows for b in run(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def test_memory_of_a_task_is_bounded(spark):
    x = np.random.default_rng(1).standard_normal((4_000, 64))
    given, peak = scan(spark, x, np.arange(2_000), 100)
    assert sum(given) == 2_000 * 100 and max(given) <= dense.GIVEN
    assert peak < 120  # 300 MB and more where all queries' candidates were measured at once


def test_neighbours_by_brute_force_with_ties(spark):
    x = np.round(np.random.default_rng(2).standard_normal((4_000, 3)), 1)
    ids = np.array([0, 7, 3_999])
    got, _ = scan(spark, x, ids, 20)
    want = []
    for q in ids.tolist():
        d = np.round(((x - x[q]) ** 2).sum(1), dense.DIGITS)
        want += [(q, int(i), d[i]) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:20]
    assert sorted(got) == sorted(want)
