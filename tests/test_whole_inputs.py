"""Queries over small tables whose rows and texts lie beyond the places where inputs were once cut."""

import re

import pytest
from pyspark.sql import functions as F

from corvane.plans import corpus, evaluation, more, retrieval
from corvane.runtime import importable

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Documents and queries of more than 64 words and 2,000 characters, with query ids from 18 on."""
    importable(spark)
    base = tmp_path_factory.mktemp("long")
    filler = lambda i, n: " ".join(f"fill{i}word{k}" for k in range(n))
    docs = [(i, f"fox {filler(i // 2, 180)} tail{i % 3} late{i} common ending{i % 4}", "en", f"s{i % 5}") for i in range(24)]
    items = [(i, f"fox {filler(i + 50, 70)} tail{i % 3} ending{i % 4}") for i in range(18, 24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), {i: (t, s) for i, t, _, s in docs}, dict(items)


def test_late_interaction_by_brute_force(spark, long_texts):
    sf, docs, items = long_texts
    words = lambda t: {*WORD.findall(t.lower())}
    known = sorted({f"^{w}$"[k : k + 3] for t in [*items.values(), *(t for t, _ in docs.values())] for w in words(t) for k in range(len(w))})
    place = {r.p: r.h for r in spark.createDataFrame([(g,) for g in known], "p string").select("p", F.pmod(F.xxhash64("p"), F.lit(64)).alias("h")).collect()}
    grams = lambda w: {place[f"^{w}$"[k : k + 3]] for k in range(len(w))}
    got = {(r.query_id, r.id): r.score for r in retrieval.ret22_late_interaction(spark, sf).collect()}
    hits = [(r.query_id, r.id) for r in retrieval.bm25_run(spark, sf, 10).collect()]
    assert {q for q, _ in hits} == set(items) and got.keys() == set(hits)
    for q, i in hits:
        d = [grams(w) for w in words(docs[i][0])]
        best = [max(len(a & b) / (len(a) * len(b)) ** 0.5 for b in d) for a in map(grams, words(items[q]))]
        assert got[q, i] == pytest.approx(sum(best) / len(best), abs=2e-6)


def test_diverse_by_brute_force(spark, long_texts):
    sf, docs, _ = long_texts
    sets = {i: {w for w in re.split(r"[^a-z0-9_]+", t.lower()) if len(w) >= 3} for i, (t, _) in docs.items()}
    got, runs = {}, {}
    for r in retrieval.ret14_diverse(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for r in retrieval.bm25_run(spark, sf, 40).collect():
        runs.setdefault(r.query_id, {})[r.id] = 1 / r.rank
    assert got.keys() == runs.keys()
    for q, base in runs.items():
        rest, out = sorted(base, key=lambda i: (-base[i], i)), []
        while rest and len(out) < 10:
            penalty = lambda i: max([0.0] + [max(0.35 * (docs[i][1] == docs[j][1]), 0.28 * len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for j, _ in out])  # noqa: B023, E731
            value = {i: base[i] - penalty(i) for i in rest}
            best = max(rest, key=value.get)
            rest.remove(best)
            out.append((best, pytest.approx(value[best], abs=2e-6)))
        assert got[q] == out


def test_shelf_scores_by_brute_force(spark, tmp_path):
    """Words past the first 200 characters count, and so do shelves without a note of an id divisible by 50."""
    docs = [(1, "alpha " + "x1 " * 100 + "omega", "near"), (50, "beta gamma", "far"), (51, "beta " * 60 + "delta omega", "far"), (52, None, "empty"), (53, "Alpha;BETA", None)]
    items = [(1, "alpha omega near"), (2, "beta delta gamma beta"), (3, "nothing here")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shelves = {s: {w for _, t, x in docs if x == s and t for w in re.findall("[a-z0-9]+", t.lower())} for _, _, s in docs}
    want = []
    for i, t in items:
        w = {*t.split()}
        score = {s: 2 * len(w & d) + 12 * (s in w) for s, d in shelves.items()}
        want += [(i, s, score[s], n + 1) for n, s in enumerate(sorted(score, key=lambda s: (-score[s], s is not None, s or "")))]
    assert sorted(map(tuple, corpus.cmd08_shelf_scores(spark, str(tmp_path)).collect()), key=lambda r: (r[0], r[3])) == want


@pytest.mark.parametrize(
    ("module", "name", "tables"),
    [
        (more, "jon08_met14_context_match", ["conversations"]),
        (evaluation, "met15_faithfulness", ["conversations"]),
        (retrieval, "ret11_auto_mode", ["benchmark", "pages", "events"]),
        (corpus, "ext07_explode_gold", ["lineitem", "part"]),
        (corpus, "cmd08_shelf_scores", ["benchmark", "documents"]),
    ],
)
def test_query_agrees_with_its_sql_over_all_rows(spark, sf, module, name, tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = module.QUERIES[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(frame.columns)} FROM ({module.SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(map(tuple, frame.collect())) == plain(want)
