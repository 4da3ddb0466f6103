"""Runs measured against label mates: results are those of the SQL, and the pairs of a label are never made."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.operators import metrics
from corvane.plans import registry


def written(folder, ids, labels):
    x = np.random.default_rng(3).standard_normal((len(ids), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


def most_rows(spark) -> int:
    """The most rows that a step of the last query gave on."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    at = runs.apply(runs.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(at), store.planGraph(at).allNodes(), 0
    for n in range(nodes.size()):
        of = nodes.apply(n).metrics()
        for m in range(of.size()):
            value = values.get(of.apply(m).accumulatorId())
            if of.apply(m).name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().split("\n")[0].replace(",", "")))
    return most


@pytest.mark.parametrize("name", ["met01_to_05_beir", "met07_eval_metrics", "jon05_run_with_judgments"])
def test_pairs_of_a_label_are_not_made(spark, tmp_path, name):
    sf = written(tmp_path, range(4_000), [1] * 4_000)
    assert registry.queries()[name](spark, sf).collect()
    assert 3_000 < most_rows(spark) < 100_000  # 160 queries have 639,840 pairs with their label mates


@pytest.mark.parametrize("name", ["met01_to_05_beir", "met07_eval_metrics", "jon05_run_with_judgments"])
def test_odd_ids_and_labels_agree_with_the_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    ids = [*range(-230, 0), *range(0, 300, 3), *range(1_000, 1_150), 5_000, 9_975]
    labels = [None if i % 11 == 0 else 7 if i == 5_000 else i % 3 for i in ids]
    sf = written(tmp_path, ids, labels)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    np.testing.assert_allclose(np.array(sorted(tuple(map(float, (r[c] for c in want.columns))) for r in got.collect())), np.array(sorted(tuple(map(float, r)) for r in want.fetchall())), atol=1.1e-6)


def test_levels_stand_for_sorted_judgments(spark):
    relevance = [3] * 4 + [2] * 3 + [1] * 9
    qrels = spark.createDataFrame([(1, i, r) for i, r in enumerate(relevance)], "query_id long, id long, relevance int")
    run = spark.createDataFrame([(1, 15, 1), (1, 0, 2), (1, 99, 3)], "query_id long, id long, rank int")
    worth = (1 / np.log2(2) + 7 / np.log2(3)) / sum((2**r - 1) / np.log2(p + 2) for p, r in enumerate(relevance[:10]))
    assert metrics.beir(run, qrels).first().ndcg_10 == pytest.approx(worth, abs=1e-6)
