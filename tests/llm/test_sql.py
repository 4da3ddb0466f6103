"""Operators with SQL: both sides on small tables that hold the odd cases."""

import pytest

from corvane.llm import quality, urlfilter

duckdb = pytest.importorskip("duckdb")


def test_url_filter_agrees_with_its_sql(spark, tmp_path):
    rows = []
    for i in range(60):
        html = {0: None, 1: f'<link rel="canonical" href="http://h{i % 7}.example.net/de/8{i}">', 2: f'<META http-equiv="refresh" content="0; URL=/es/{i}">', 3: f"<link href='page{i + 1}' rel=canonical>", 4: "<link rel=stylesheet href=x><p>"}[i % 5]
        rows.append((i, None if i % 13 == 0 else f"http://h{i % 4}.example.{('com', 'net', 'org', 'test')[i % 4]}/{('en', 'de', 'es', 'x')[i % 3]}/{i % 9}{'?q=1' if i % 6 == 0 else ''}{'#f' if i % 8 == 0 else ''}", html))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, urlfilter.op3_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.SQL['op3_url_filter']})").fetchall())
    assert got == want
    assert any(v == "block" and r is None for *_, r, v in got)


def test_quality_rules_agree_with_their_sql(spark, tmp_path):
    texts = [None, "", " \n\n ", "a b c " * 40, "the " * 25, "x\ny\nx\nx " + "word " * 30, "$$$ ### " * 20, "é à 日本 " * 12, "one two three four five six seven eight nine ten " * 3, "WOW!! " * 30]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    frame = quality.op10_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(frame.columns)} FROM ({quality.SQL['op10_quality_rules']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want)
