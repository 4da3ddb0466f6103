"""Sketched search: recall on vectors that are spread evenly, the share of rows that is measured, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dense


def table(spark, n, seed):
    x = np.random.default_rng(seed).standard_normal((n, 64))
    return spark.createDataFrame([(i, [float(v) for v in row / np.linalg.norm(row)]) for i, row in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("n", [2_000, 12_000])
def test_recall_is_at_least_95_percent(spark, n, monkeypatch):
    rows = table(spark, n, n).cache()
    queries = rows.filter(F.col("id") % (n // 40) == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact, found = ({(r.query_id, r.id): r.score for r in f(queries, rows, 10).collect()} for f in (dense.knn, dense.sketched_knn))
    assert len(found) == 400 and len(exact.keys() & found.keys()) >= 0.95 * 400
    assert all(found[p] == exact[p] for p in exact.keys() & found.keys())
    x = np.array([r.v for r in rows.orderBy("id").collect()])
    sketch = dense._sketches(x, dense.directions(dense.BITS, 64))
    apart = np.array([np.bitwise_count(sketch[i] ^ sketch).sum(1) for i in range(0, n, n // 40)])
    limit = np.sort(apart, axis=1)[:, int(np.ceil(n * dense.SHARE))]
    assert ((apart <= limit[:, None]).mean(1) < 0.1).all()  # rows measured, of all
    rows.unpersist()


def test_few_rows_are_all_found_and_partitions_change_nothing(spark, monkeypatch):
    rows = table(spark, 60, 1).union(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    queries = rows.filter("id < 20").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    pairs = lambda df: sorted(map(tuple, df.collect()))
    one = pairs(dense.sketched_knn(queries, rows.coalesce(1), 10))
    monkeypatch.setattr(dense, "QUERY_NUMBERS", 200)
    assert pairs(dense.sketched_knn(queries, rows.repartition(7), 10)) == one and len(one) == 200
    assert pairs(dense.knn(queries, rows.repartition(3), 10)) == pairs(dense.knn(queries, rows.coalesce(1), 10))
    assert dense.sketched_knn(queries.limit(0), rows, 10).count() == 0 == dense.sketched_knn(queries, rows.limit(0), 10).count()
