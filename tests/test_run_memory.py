"""Queries that compare runs of two models: what a task holds grows far slower than its table, and a scan in many parts loses nothing."""

import numpy as np
import pytest
from test_judged_runs import written
from test_knn_memory import scan

from corvane.operators import dense
from corvane.plans import registry


@pytest.mark.parametrize("dims", [64, 32])
def test_memory_grows_slower_than_the_input(spark, dims):
    x = np.random.default_rng(4).standard_normal((8_000, dims))
    (few, small), (many, large) = (scan(spark, x[:n], np.arange(0, n, 2), 100) for n in (2_000, 8_000))
    assert (sum(few), sum(many)) == (1_000 * 100, 4_000 * 100)
    assert large < 1.5 * small  # four times where all queries' candidates were measured at once


@pytest.mark.parametrize("name", ["agg09_domains", "ext05_rollout", "met10_models_side_by_side"])
def test_many_blocks_and_tiles_agree_with_the_sql(spark, tmp_path, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    for bound, most in (("QUERY_NUMBERS", 1_000), ("CELLS", 3_000), ("GIVEN", 150)):  # blocks of ten queries, tiles of five
        monkeypatch.setattr(dense, bound, most)
    ids = [*range(-120, 300), *range(1_000, 1_150), 5_000, 9_975]
    sf = written(tmp_path, ids, [None if i % 11 == 0 else 7 if i == 5_000 else i % 3 for i in ids])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    named = lambda rows: sorted(([v for v in r if isinstance(v, str)], [float(v) for v in r if not isinstance(v, str)]) for r in rows)
    got, want = named([r[c] for c in want.columns] for r in got.collect()), named(want.fetchall())
    assert [words for words, _ in got] == [words for words, _ in want]
    np.testing.assert_allclose(np.array([numbers for _, numbers in got]), np.array([numbers for _, numbers in want]), atol=1.1e-6)
