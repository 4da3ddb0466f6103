"""Operators over the whole corpus: sharding, mixing, urls, nearest neighbours, toxicity, Jaccard join, and the pipeline."""

import collections
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane.llm import ann, common, components, jaccard, mixing, sharding, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _workers(spark):
    common.importable(spark)


def test_shards_have_exact_sizes_and_gapless_slots(spark, sf):
    rows = sharding.op1_hypergeometric_sharding(spark, sf).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert {len(s) for s in slots.values()} <= {len(rows) // 16, len(rows) // 16 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_communication_matrix_margins_and_variance(spark):
    counts = spark.createDataFrame([(i, 50) for i in range(40)], "__part long, n long")
    cells = np.array([r.row for seed in (0, 2, 4, 6, 8) for r in sharding.communication_matrix(counts, 4, seed)[0].orderBy("__part").collect()])
    assert (cells.sum(1) == 50).all() and (cells[:40].sum(0) == 500).all()
    assert abs(cells.var() - 50 * 0.25 * 0.75 * 1950 / 1999) < 2


def test_sharding_odd_rows(spark, documents):
    odd = documents([(None, None, "en", "a", 0)] * 7 + [(1, "x", "en", "a", 0)] * 20).selectExpr("*", "1 as row", "2 as n")
    got = sharding.shard(odd, 3).collect()
    assert sorted(collections.Counter(r.shard for r in got).values()) == [9, 9, 9]
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def brute_components(docs):
    """doc_id -> (n_shingles, component_id), by comparing all pairs of sets."""
    word, lower = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets, up = {}, {}
    for i, text in docs:
        w = word.findall((text or "").translate(lower))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_matches_brute_force(spark, documents):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    common_passage = " ".join(rng.choice(words, 60))
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 80)))) for i in range(60)]
    base = list(rng.choice(words, 150))
    for i in range(60, 140):  # a group of near copies at the border of the threshold
        copy = base.copy()
        for k in rng.choice(150, rng.integers(0, 5), replace=False):
            copy[k] = f"x{rng.integers(1000)}"
        docs.append((i, " ".join(copy).upper() if i % 3 else " ".join(copy)))
    docs += [(i, common_passage + " " + " ".join(rng.choice(words, rng.integers(0, 14)))) for i in range(140, 200)]
    docs += [(i, docs[70][1]) for i in range(200, 230)] + [(230, None), (231, " \n"), (232, "a b"), (233, "A\tb")]
    got = jaccard.join(documents([(i, t, "en", "s", 1) for i, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_jaccard_odd_rows(spark, documents):
    text = "one two three four five six"
    got = jaccard.join(documents([(5, text, "en", "a", 1), (5, "other words of the same id", "en", "a", 1), (3, "other words of the same id", "en", "a", 1), (None, text, "en", "a", 1), (9, text, "en", "a", 1)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (5, 3), (5, 3), (9, 3)]
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 201), (201, 200)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_components_after_more_links(spark):
    scratch = common.Scratch(spark, "t")
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    parts = components.connected_components(links([(5, 6), (6, 7), (1, 2), (20, 21)]), scratch)
    got = components.merged_components(parts, links([(7, 2), (30, 31), (31, 6), (31, 6), (40, 41)]), scratch).collect()
    want = dict.fromkeys((1, 2, 5, 6, 7, 30, 31), 1) | {20: 20, 21: 20, 40: 40, 41: 40}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_rake_reaches_marginals_both_ways(spark):
    rows = [(f"s{i % 5}", f"l{i % 3}", f"t{i % 2}", float(10 + i * 7 % 50)) for i in range(30)]
    cells = spark.createDataFrame(rows, "__source string, __lang string, __topic string, w double").groupBy("__source", "__lang", "__topic").sum("w").withColumnRenamed("sum(w)", "w")
    wanted = {"lang": {"l0": 2.0, "l1": 1.0, "l2": 1.0}}
    on_driver = {tuple(r)[:3]: r["__prob"] for r in mixing._rake_on_driver(cells, wanted, 0.2).collect()}
    as_table = {tuple(r)[:3]: r["__prob"] for r in mixing._rake_as_table(cells, wanted, 0.2, common.Scratch(spark, "t")).collect()}
    assert on_driver.keys() == as_table.keys()
    assert all(abs(on_driver[k] - as_table[k]) < 1e-3 for k in on_driver)
    weights = {tuple(r)[:3]: r["w"] for r in cells.collect()}
    kept = collections.Counter()
    for k, p in on_driver.items():
        assert p < 1
        kept[k[1]] += weights[k] * p
    assert abs(kept["l0"] / sum(kept.values()) - 0.5) < 1e-6
    assert abs(sum(kept.values()) - 0.2 * sum(weights.values())) < 1e-6


def sparse_cells(n, sources, spread):
    """Weights of sparse cells, and other weights of theirs, whose marginals can be met."""
    rng = np.random.default_rng(4)
    cells = sorted({(int(rng.integers(sources)), int(rng.integers(4)), int(rng.integers(3))) for _ in range(n)})
    return cells, *(np.exp(spread * rng.standard_normal(len(cells))) for _ in range(2))


def test_raking_goes_on_until_the_marginals_are_met():
    cells, weights, goal = sparse_cells(90, 40, 3)
    codes = [np.unique([c[d] for c in cells], return_inverse=True)[1] for d in range(3)]
    targets = [np.bincount(c, goal) / goal.sum() for c in codes]
    fitted = mixing.rake(codes, weights, targets)
    assert max(abs(np.bincount(c, fitted) / t - 1).max() for c, t in zip(codes, targets, strict=True)) < 2e-6


def test_raking_as_table_agrees_on_sparse_cells_and_large_scales(spark):
    cells, weights, goal = sparse_cells(40, 8, 1.5)
    weights = weights * np.array([1e4 if s == 0 else 1 for s, *_ in cells])
    names = [tuple(f"{k}{v}" for k, v in zip("slt", c, strict=True)) for c in cells]
    table = spark.createDataFrame([(*k, float(w)) for k, w in zip(names, weights, strict=True)], "__source string, __lang string, __topic string, w double")
    wanted = {d: {} for d in mixing.DIMENSIONS}
    for k, g in zip(names, goal, strict=True):
        for d, v in zip(mixing.DIMENSIONS, k, strict=True):
            wanted[d][v] = wanted[d].get(v, 0.0) + float(g)
    on_driver = {tuple(r)[:3]: r["__prob"] for r in mixing._rake_on_driver(table, wanted, 0.99).collect()}
    as_table = {tuple(r)[:3]: r["__prob"] for r in mixing._rake_as_table(table, wanted, 0.99, common.Scratch(spark, "t")).collect()}
    assert max(abs(on_driver[k] - as_table[k]) for k in names) < 1e-3
    assert sum(w * as_table[k] for k, w in zip(names, weights, strict=True)) == pytest.approx(0.99 * weights.sum(), rel=1e-6)


def test_mixing_odd_rows(spark, documents):
    rows = [(i, "word " * 50, "en", "hot", 1) for i in range(50)] + [(100, None, None, None, 0), (101, "", "en", "a", 0)]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == 52 and all(r["__kept"] for r in got if not r.text)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_urls_rules_and_aliases(spark):
    html = '<html><link href="https://example.net/de/81" rel="canonical"></html>'
    pages = [
        (1, "HTTPS://Example.COM/en/71?x", None), (2, "http://a.example.com/en/8", None), (3, "http://q.test/x/y", html), (4, "nothing", html), (5, None, None),
        (6, "http://q.test/z", '<META http-equiv=refresh content="0; url=y2">'), (7, "http://q.test/y2", None), (8, "http://com/en/", None), (9, "http://r.test/", '<link rel=canonical href="/en">'),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects=spark.createDataFrame([("http://q.test/y2", "http://x.org/es/1")], "src string, dst string")).collect()}
    assert got[1] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("q.test", "/x/y", None, "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "block")
    assert got[8] == ("com", "/en/", "com/en/", "block") and got[9][3] == "allow"
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nearest_recall_against_brute_force(spark, sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = collections.defaultdict(list)
    for r in ann.op4_adaptive_scan_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        hits += len({*ids[np.lexsort((ids, -s))[:20]]} & {*got[ids[i]]})
    assert hits / (20 * len(got)) > 0.9


@pytest.mark.parametrize("width", [256, 768])
def test_scan_of_wide_vectors_loses_next_to_nothing(width):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4_000, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = ann.Lists(x[:500], len(x), 1.0)
    ids, rotated = np.arange(len(x)), (lists.lift(x) @ lists.rotation).astype(np.float32)
    hits = 0
    for i in range(40):
        found, _ = ann.scan(ids, x, rotated, i, x[i], (np.append(x[i], 0.0) @ lists.rotation).astype(np.float32), 1 + lists.norm**2, 20)
        hits += len({*found} & {*np.argsort(-(x @ x[i]))[1:21]})
    assert hits / (40 * 20) > 0.99


def test_nearest_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0]), (5, [2.0, 0.0]), (8, [0.5, 9.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 5, 2.0), (0, 2, 6, 2.0), (0, 3, 8, 0.5)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_vectors(bags, idf):
    """Term -> weight of unit length for each bag; written apart from the index."""
    out = []
    for bag in bags:
        v = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items() if t in idf}
        size = math.sqrt(sum(w * w for w in v.values()))
        out.append({t: w / size for t, w in v.items()} if size else {})
    return out


def brute_terms(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return collections.Counter(words + ["^" + w[:4] for w in words if len(w) > 4])


def test_toxicity_neighbours_are_exact_and_votes_tell(spark, documents):
    rng = np.random.default_rng(2)
    plain = [chr(97 + i % 26) + chr(97 + i // 26) + "q" for i in range(300)]
    docs = [(i, " ".join(rng.choice(plain, 30)) + (" vile nastyish vile" if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    docs += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, docs[350][1], "en", "s", 1)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(documents(docs), labels)
    got = {r.doc_id: r for r in toxicity.score(documents(docs), index, evidence=True).collect()}
    assert np.mean([(got[i].score >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) > 0.9
    assert got[900].score == got[901].score < 0.5 and got[902].score == got[350].score
    rows = sorted(toxicity.training_rows(documents(docs), labels).collect())
    bags = [brute_terms(r.text) for r in rows]
    found = collections.Counter(t for b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) for t, n in found.items()}
    examples = brute_vectors(bags, idf)
    for i in range(300, 400):
        (query,) = brute_vectors([brute_terms(docs[i][1])], idf)
        exact = sorted((sum(w * e.get(t, 0) for t, w in query.items()) for e in examples), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose([n.cosine for n in got[i].neighbours], exact, atol=1e-5)


def test_toxicity_ties_go_to_the_smaller_id():
    """Copies of one example tie; the smaller half, in the order of ids, is clean."""
    n = 2 * toxicity.NEIGHBOURS
    bags = [{"same": 1, "text": 1}] * n + [{"other": 1, f"w{i}": 1} for i in range(200)]
    index = toxicity.Index(bags, [0] * toxicity.NEIGHBOURS + [1] * toxicity.NEIGHBOURS + [0] * 200)
    ((j, s),) = index.nearest([index.vector({"same": 1, "text": 1})])
    assert sorted(index.turn[j]) == list(range(toxicity.NEIGHBOURS)) and np.allclose(s, 1)


def test_toxicity_skips_blocks_that_cannot_matter():
    rng = np.random.default_rng(3)
    themes = [[f"t{k}w{i}" for i in range(40)] for k in range(30)]
    bags = [collections.Counter(rng.choice(themes[i % 30], 20).tolist()) for i in range(3000)]
    index = toxicity.Index(bags, [i % 2 for i in range(3000)])
    index.scored = index.blocks = 0
    index.nearest([index.vector(b) for b in bags[:50]])
    assert index.scored < 0.5 * index.blocks


def test_toxicity_of_few_examples_keeps_all_their_terms(spark, documents):
    rng = np.random.default_rng(6)
    plain = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(plain, 20)) + (f" vile nasty {'xyz'[i % 3] * 3}" if i % 6 == 0 else ""), "en", "s", 1) for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(documents(docs), labels)
    rows = toxicity.training_rows(documents(docs), labels).collect()
    assert set(index.number) == {t for r in rows for t in toxicity.terms(r.text)}
    held = [(i, text) for i, text, *_ in docs if i not in {r.doc_id for r in rows}]
    scores = [p for p, *_ in index.score([text for _, text in held])]
    assert len(set(scores)) > 1
    assert all((p >= 0.5) == (i % 6 == 0) for (i, _), p in zip(held, scores, strict=True))


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a text", "en", "s", 1)])
    assert toxicity.score(docs, toxicity.fit(docs, none)).collect()[0].score < 0.5


def test_pipeline_stages_keep_columns_and_agree_with_parts(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.selectExpr("*", "lang as score", "source as component_id", "n_chars as n")
    rows = {r.doc_id: r.text for r in docs.collect()}
    truth = brute_components([(i, t) for i, t in rows.items()])
    kept = corpus_pipeline.ngram_jaccard(spark, corpus_pipeline.language_id(spark, extra, sf), sf)
    assert kept.columns == extra.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, c) in truth.items() if i == c}
    cleaned = corpus_pipeline.secret_scan(spark, docs, sf)
    assert cleaned.count() == len(rows) and not any(re.search("AKIA[A-Z0-9]{16}", r.text) for r in cleaned.collect())
    assert set(corpus_pipeline.mixing_sources(spark, docs, sf).columns) == set(docs.columns)
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) <= len(rows) and len({r.doc_id for r in out}) == len(out)
