"""Postings met by query terms: results are those of the SQL, texts are counted a part at a time, and pairs of queries and postings are never made."""

import pytest
from test_judged_runs import most_rows

from corvane.plans import more


def written(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("sent", [more.SENT_TERMS, 3, 0])
def test_ids_that_repeat_agree_with_the_sql(spark, tmp_path, monkeypatch, sent):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(more, "SENT_TERMS", sent)
    texts = ["red fox red", "Red camelCase", None, "", "fox fox fox", "x1 fox red hen", "nothing asked"]
    docs = [(i % 5 if i % 7 else None, texts[i % len(texts)], "s") for i in range(60)] + [(1, "red red fox", "s"), (1, "red", "s"), (None, "hen hen", "s")]
    items = [(1, "red fox red"), (2, "Fox case"), (2, "fox hen"), (None, "red"), (None, "red hen"), (3, None), (4, "unheard")]
    sf = written(spark, tmp_path, docs, items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    frame = more.jon04_postings_join(spark, sf)
    want = con.sql(f"SELECT {', '.join(frame.columns)} FROM ({more.SQL['jon04_postings_join']})").fetchall()
    assert len(want) == 4
    assert sorted(map(tuple, frame.collect())) == sorted(want)


def test_pairs_are_not_made_and_texts_are_taken_in_parts(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(10))
    sf = written(spark, tmp_path, [(i, text, "s") for i in range(500)], [(i, text) for i in range(500)])
    frame = more.jon04_postings_join(spark, sf)
    assert "EvalPython" not in frame._jdf.queryExecution().executedPlan().toString()  # which holds the tokens of 10,000 records at once
    assert {tuple(r) for r in frame.collect()} == {(f"w{i}", 250_000, 250_000) for i in range(10)}
    assert most_rows(spark) < 100_000  # 2,500,000 pairs of a posting and a query
