"""Readers, writers, the chunker, streams, and the registry."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corvane.plans import corpus, registry
from corvane.sources import files
from corvane.streaming import jobs


def test_scan_takes_what_the_filter_takes(spark, tmp_path):
    for name in ("kb1/a.md", "kb1/logs/b.md", "kb1/logs.md", "kb1/x/.hidden.md", "kb1/c.exe", "kb2/tmp/d.md", "kb2/e/f.TXT", "kb2/_seen.json"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("héllo")
    got = {(r.kb, r.relative_path) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {("kb1", "a.md"), ("kb1", "logs.md"), ("kb2", "e/f.TXT")}
    assert files.whole_text(files.scan(spark, str(tmp_path)), 2).first().text == "h"


def test_delimited_text_keeps_quotes_and_chunks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,note\n"a, b","say ""hi"""\nc,d\n')
    got = files.delimited_text(spark, str(tmp_path / "t.csv")).collect()
    assert [r.text for r in got] == ['source_path: t.csv\nrows: 1-2\ncolumns: name | note\n\nrow 1: name=a, b | note=say "hi"\nrow 2: name=c | note=d']
    cut = files.delimited_text(spark, str(tmp_path / "t.csv"), chunk=60).orderBy("part").collect()
    assert [r.text.split("\n")[1] for r in cut] == ["rows: 1-1", "rows: 2-2"]


def test_notebook_html_and_json_lines(spark, tmp_path):
    book = {"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"text": ["2"]}]}]}
    df = spark.createDataFrame([(json.dumps(book), "n.ipynb"), ("{", "bad")], "text string, path string")
    rows = {r.path: r.text for r in files.notebook_text(df).collect()}
    assert rows == {"n.ipynb": "source_path: n.ipynb\n\ncell 1/2 (markdown):\n# T\n\ncell 2/2 (code):\n1+1\noutput:\n2", "bad": None}
    page = spark.createDataFrame([("<p>a <b>b</b></p><script>x</script><p>&amp;c</p>",)], "html string")
    assert files.html_text(page).first().text == "a b\n&c"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n')
    assert sorted((r.malformed, r.a) for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "a INT").collect()) == [(False, 1), (True, None)]


def test_judged_collection_and_run_lines(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "x"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    c, q, r = files.judged_collection(spark, str(tmp_path))
    assert (c.count(), q.count(), r.first().relevance) == (1, 1, 2)
    run = spark.createDataFrame([("q1", "d1", 1, 0.5)], "query_id string, id string, rank int, score double")
    assert files.run_lines(run, "tag").first().value == "q1 Q0 d1 1 0.500000 tag"


def test_globs_cross_folders_only_by_two_stars(spark):
    p = corpus.glob_pattern("a/*/c?.md")
    df = spark.createDataFrame([("a/b/c1.md",), ("a/b/x/c1.md",), ("a/b/c.md",)], "p string")
    assert [r.p for r in df.filter(F.col("p").rlike(p)).collect()] == ["a/b/c1.md"]


def test_ingest_appends_each_row_once(spark, tmp_path, sf):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    docs.write.parquet(source)
    for turn in range(2):
        jobs.ingest(jobs.read_stream(spark, source, docs.schema), target, str(tmp_path / f"check{turn}")).awaitTermination(120)
    assert spark.read.parquet(target).count() == 20


def test_breaker_opens_and_recovers(spark):
    calls = [(1, i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, False), (3, True), (40, True), (41, True)])]
    got = jobs.breaker(spark.createDataFrame(calls, "provider long, event_id long, at double, ok boolean")).orderBy("event_id").collect()
    assert [r.state for r in got] == ["closed", "closed", "closed", "open", "half_open", "closed"]


def test_every_sql_has_a_query_and_entry_runs(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


AGREE = (
    "ret02_sq8_knn", "ret03_hashed_knn", "ret05_bm25", "ret05_titled", "ret06_bm25_per_kb", "ret07_bm25_by_source", "ret09_rrf", "ret10_hybrid", "ret13_source_cap", "ret23_hash_embedding", "flt02_kb_scoped_knn",
    "jon06_neighbours", "met01_to_05_beir", "met07_ranked_metrics", "met09_alpha_ndcg", "met06_latency", "sta04_wild_bootstrap", "sta09_noise_floor", "agg03_log_summary", "agg04_bucket_quantile", "cmd11_relevance_gate",
    "win01_packed_snippets", "prj02_strict_frontmatter", "prj04_rewrite_frontmatter", "prj14_append_to_section", "prj15_references", "src11_json_rows", "str07_breaker", "udf02_reranker", "udf04_decomposer", "udf05_entailment",
)


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "pages", "benchmark", "labels", "conversations", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", AGREE)
def test_queries_agree_with_their_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    rows = lambda xs, names: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in (r[names.index(c)] for c in order)) for r in xs), key=repr)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)
