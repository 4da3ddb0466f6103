"""Plug-ins that fail, gates and packing by hand."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import dense, metrics, plugins
from corvane.plans import ranking


def test_a_failing_scorer_degrades_its_queries_alone(spark):
    def scorer(queries, texts):
        if "bad" in texts:
            raise ValueError
        return [float(len(t)) for t in texts]

    rows = [(q, "q", 10 * q + r, r, "bad" if (q, r) == (1, 2) else "x" * r) for q in (1, 2) for r in range(1, 5)]
    got = plugins.rerank(spark.createDataFrame(rows, "query_id long, query string, id long, rank int, text string"), scorer, 3).orderBy("query_id", "rank").collect()
    assert [(r.id, r.degraded) for r in got] == [(11, True), (12, True), (13, True), (14, True), (23, False), (22, False), (21, False), (24, False)]
    assert [r.rerank_score for r in got if r.query_id == 1] == [1.0, None, 3.0, None]


def test_a_failing_decomposer_leaves_the_query_whole(spark):
    split = lambda texts: [t.split("/") if "!" not in t else 1 / 0 for t in texts]
    got = plugins.decompose(spark.createDataFrame([(1, "a/b"), (2, "no!")], "id long, text string"), split).collect()
    assert sorted((r.id, r.part, r.subquery) for r in got) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "no!")]


def test_the_gate_keeps_the_best_and_cuts_at_the_widest_gap(spark):
    rows = [(1, 1, 1, 2.0, False, False), (1, 2, 2, 1.5, False, False)]
    rows += [(2, 1, 1, 0.1, True, False), (2, 2, 2, 0.2, False, False), (2, 3, 3, 0.9, False, False), (2, 4, 4, None, True, False), (2, 5, 5, 0.1, False, True)]
    c = spark.createDataFrame(rows, "query_id long, id long, rank int, distance double, lexical boolean, excluded boolean")
    got = {(r.query_id, r.id): r.verdict for r in ranking.gate(c).collect()}
    assert got == {(1, 1): "kept", (1, 2): "A1-score-floor", (2, 1): "kept", (2, 2): "kept", (2, 3): "A2-distribution-knee", (2, 4): "kept", (2, 5): "policy"}


def test_packing_cuts_what_does_not_fit_and_goes_on(spark):
    rows = [(1, 1, 1, "h\n", "a" * 78, False), (1, 2, 2, "h\n", "First sentence that is long enough to be kept. " + "b" * 400, False), (1, 3, 3, "h\n", "c", True), (1, 4, 4, "h\n", "d", False)]
    h = spark.createDataFrame(rows, "query_id long, rank int, id long, head string, content string, excluded boolean")
    (got,) = ranking.pack_context(h, 60).collect()
    assert (got.included, got.truncated, got.policy, got.excluded) == ("1,2", "2", 1, 2) and got.used <= 60
    (tight,) = ranking.pack_context(h, 22).collect()
    assert (tight.included, tight.truncated) == ("1,4", "")


def test_nearest_ranks_by_hand(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 9)] + [("b", None), ("c", 5)], "k string, v long")
    got = {r.k: (r.p50, r.p75, r.p99) for r in metrics.nearest_ranks(df, ["k"], "v", {"p50": 0.5, "p75": 0.75, "p99": 0.99}).collect()}
    assert got == {"a": (2, 2, 9), "c": (5, 5, 5)}


@pytest.mark.parametrize("strategy", sorted(plugins.STRATEGIES))
def test_strategies_find_a_copy_first(spark, strategy):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(42)], "id long, v array<double>")
    q = v.filter("id < 2").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = plugins.search(q, v, 1, strategy).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(0, 21), (1, 22)] and all(r.score < 0.01 for r in got)
    assert dense.knn(q.filter("false"), v, 1).count() == 0
