"""The lexical index that is kept: equal results, pruned reads, refreshes, and a pointer that moves last."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import index, lexical
from corvane.sources.versions import Versions, fingerprint

WORDS = "red blue green fox dog cat getUserName été v2 ﬁne ＡＢＣ naïve ① lion bear wolf".split()


def records(spark, n=90, kind="long", other=()):
    rows = [(f"d{i}" if kind == "string" else i, None if i == 3 else " ".join(WORDS[(i * k + k) % 16] for k in range(1, 4 + i % 6)) if i % 11 else "", None if i % 13 == 12 else f"s{i % 3}", WORDS[i % 9]) for i in range(n)]
    return spark.createDataFrame([*[r for r in rows if r[0] not in {o[0] for o in other}], *[o for o in other if len(o) > 1]], f"id {kind}, text string, source string, title string")


def queries(spark, kind="long"):
    rows = [(1, "blue fox fine"), (1, "blue dog"), (2, "GetUserName abc 1"), (3, None), (4, "nothing known"), (None, "red"), (5, "ÉTÉ naïve ｌｉｏｎ")]
    return spark.createDataFrame([(f"q{q}" if kind == "string" and q else q, t) for q, t in rows], f"qid {kind}, text string")


def listed(df):
    return sorted(map(str, (r.asDict() for r in df.select("query_id", "kb", "id", "score", "rank").collect())))


@pytest.mark.parametrize("kind, title", [("long", None), ("string", "title")])
def test_the_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, kind, title):
    """All three ways (scan, joined postings, index in one block and in many), with scopes, titles, null and empty texts, ties and compatibility forms."""
    monkeypatch.setattr(index, "SMALL_SHARD", 400)
    monkeypatch.setattr(index, "CELLS", 40)
    docs, asked = records(spark, kind=kind), queries(spark, kind)
    kept = index.LexicalIndex(spark, str(tmp_path / "i"))
    assert kept.refresh(docs, "id", "text", F.col("source"), title) == {"added": 90, "changed": 0, "removed": 0}
    assert kept.versions.state()["shards"] > 3
    for scoped, whole, blocks in ((False, False, (4,)), (True, False, (lexical.QUERY_CELLS,)), (True, True, (lexical.QUERY_CELLS,))):
        scan, joined = (listed(lexical.search(docs, "id", "text", asked, "qid", "text", 5, F.col("source") if scoped else None, title, most, whole)) for most in (lexical.QUERY_CELLS, 0))
        assert scan and scan == joined
        assert all(listed(kept.search(asked, "qid", "text", 5, scoped, whole, most)) == scan for most in blocks)
    assert any("'q5'" in r or "'query_id': 5" in r for r in scan)


def test_scopes_are_ranked_as_whole_texts(spark, tmp_path):
    docs, asked = records(spark).filter("source is not null"), queries(spark)
    kept = index.LexicalIndex(spark, str(tmp_path / "i"))
    kept.refresh(docs, "id", "text", F.col("source"))
    whole = docs.groupBy("source").agg(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n").alias("text"))
    want = {(r.query_id, r.id): (r.score, r["rank"]) for r in lexical.search(whole, "source", "text", asked, "qid", "text", 2).collect()}
    rows = kept.search_scopes(asked, "qid", "text", 2).collect()
    assert want and {(r.query_id, r.kb): (r.score, r["rank"]) for r in rows} == want
    best = {(r.query_id, r.kb): r.id for r in lexical.search(docs, "id", "text", asked, "qid", "text", 1, F.col("source"), whole=True).collect()}
    assert all(best[r.query_id, r.kb] == r.best for r in rows)


def test_a_search_opens_only_the_files_of_its_terms(spark, tmp_path):
    kept = index.LexicalIndex(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 400}" for j in range(30))) for i in range(200)], "id long, text string")
    kept.refresh(docs, "id", "text")
    rows = kept.postings(["w5"])
    plan = rows._jdf.queryExecution().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,w5)" in plan.split("PushedFilters: [")[1].split("\n")[0]
    opened = {f for f in rows.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(opened) == 1 and len(list((tmp_path / "i/postings").rglob("*.parquet"))) >= 16
    assert {r.term for r in rows.collect()} == {"w5"}


def test_a_refresh_writes_what_changed_and_nothing_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SMALL_SHARD", 400)
    monkeypatch.setattr(index, "MOST_VERSIONS", 3)
    path, asked = tmp_path / "i", queries(spark)
    kept = index.LexicalIndex(spark, str(path))
    kept.refresh(records(spark), "id", "text", F.col("source"))
    before = {f: os.stat(f).st_mtime_ns for f in path.rglob("*.parquet")}
    # 5 changes its text, 6 its shelf, 7 goes, 500 comes
    then = records(spark, other=[(5, "fox fox wolf", "s1", "x"), (6, "fine fox", "s2", "x"), (7,), (500, "blue blue abc fox", None, "y")])
    assert kept.refresh(then, "id", "text", F.col("source")) == {"added": 1, "changed": 2, "removed": 1}
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    new = spark.read.parquet(str(path / "postings/version=1"))
    assert {i for r in new.collect() for i in r.ids} == {5, 6, 500}
    fresh = index.LexicalIndex(spark, str(tmp_path / "fresh"))
    fresh.refresh(then, "id", "text", F.col("source"))
    for scoped in (False, True):
        assert listed(kept.search(asked, "qid", "text", 9, scoped)) == listed(fresh.search(asked, "qid", "text", 9, scoped))
    assert sorted(map(str, kept.totals().collect())) == sorted(map(str, fresh.totals().collect()))
    # nothing changed: no tables, only the pointer; then back again, then beyond the most versions all is built anew
    assert kept.refresh(then, "id", "text", F.col("source")) == {"added": 0, "changed": 0, "removed": 0}
    assert not (path / "postings/version=2").exists()
    assert kept.refresh(records(spark), "id", "text", F.col("source")) == {"added": 1, "changed": 2, "removed": 1}
    assert len(kept.versions.state()["live"]) == 3
    kept.refresh(then, "id", "text", F.col("source"))
    assert kept.versions.state()["live"] == [4] and listed(kept.search(asked, "qid", "text", 9)) == listed(fresh.search(asked, "qid", "text", 9))


def test_a_crash_before_the_pointer_leaves_the_old_index(spark, tmp_path, monkeypatch):
    asked = queries(spark)
    kept = index.LexicalIndex(spark, str(tmp_path / "i"))
    kept.refresh(records(spark), "id", "text")
    old = listed(kept.search(asked, "qid", "text", 5))
    then = records(spark, other=[(5, "fox fox wolf", "s1", "x"), (9,)])

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versions, "move", crash)
        with pytest.raises(RuntimeError, match="lost"):
            kept.refresh(then, "id", "text")
    assert listed(kept.search(asked, "qid", "text", 5)) == old
    assert kept.refresh(then, "id", "text") == {"added": 0, "changed": 1, "removed": 1}
    assert listed(kept.search(asked, "qid", "text", 5)) == listed(lexical.search(then, "id", "text", asked, "qid", "text", 5)) != old


def test_an_index_of_files_follows_the_files(spark, tmp_path, monkeypatch):
    records(spark).coalesce(1).write.parquet(str(tmp_path / "notes.parquet"))
    monkeypatch.setattr(index, "shared_folder", lambda _: str(tmp_path / "shared"))
    first = index.index_of(spark, str(tmp_path), "notes", "id", "text")
    again = index.index_of(spark, str(tmp_path), "notes", "id", "text")
    assert again.versions.path == first.versions.path and again.versions.state()["version"] == 0
    print_ = fingerprint(spark.read.parquet(str(tmp_path / "notes.parquet")))
    records(spark, 91).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "notes.parquet"))
    assert fingerprint(spark.read.parquet(str(tmp_path / "notes.parquet"))) != print_
    assert index.index_of(spark, str(tmp_path), "notes", "id", "text").versions.state()["version"] == 1
    assert first.records().count() == 91
