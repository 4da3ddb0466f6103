"""Odd rows for every operator and pipeline stage: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import ann, bpe, common, jaccard, langid, mixing, quality, secrets, sharding, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on a mat " * 30_000
ROWS = [
    (1, "the cat sat on the mat and it was good", "en", "a", 38),
    (2, "der hund lief und die katze schlief im haus", "de", "b", 43),
    (2, "der hund lief und die katze schlief im haus", "de", "b", 43),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "en", "a", 4),
    (None, "the cat sat on the mat and it was good", "en", "a", 38),
    (6, LONG, "en", "hot", len(LONG)),
    (7, "password: hunter22 in the house", "en", "hot", 31),
    (8, "12345 !!! ###", None, "c", 13),
]
#: Names that operators use for what they add.
CLASHES = "secrets ids decoded n_tokens shard slot score lang_pred kept n_words component_id n_shingles node token host path rule verdict neighbours tokens prob row value k1 n".split()


@pytest.fixture(autouse=True)
def _workers(spark):
    common.importable(spark)


@pytest.fixture
def odd(spark, documents):
    return documents(ROWS).selectExpr("*", *(f"'own' AS `{c}`" for c in CLASHES))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(odd, empty):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(ROWS) and sorted(collections.Counter(r.shard for r in got).values()) == [3, 3, 4]
    assert {r.token for r in got} == {"own"} and collections.Counter(str(r.text) for r in got) == collections.Counter(str(r[1]) for r in ROWS)
    assert sharding.shard(empty, 3).count() == 0


def test_sharding_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in common.read(spark, sf, "documents", "doc_id", "text").collect()}
    got = sharding.op1_hypergeometric_sharding(spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert len(got) == len(docs) and {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_shards_take_all_parts_of_a_table_alike(spark):
    """Rows of the first tenth of a table lie in shards and halves of shards as the hypergeometric law has them."""
    got = sharding.shard(spark.range(0, 4_000, 1, 10), 4).collect()
    first = [r for r in got if r.id < 400]
    per_shard = collections.Counter(r.shard for r in first)
    assert all(abs(per_shard[s] - 100) < 45 for s in range(4))
    assert abs(sum(r.slot < 500 for r in first) - 200) < 60
    assert [r.id for r in sorted(got, key=lambda r: (r.shard, r.slot))] != sorted(r.id for r in got)


@pytest.mark.parametrize(("n", "k", "t"), [(3_000, 2_000, 9_000), (40_000, 900, 50_000), (10**6, 4 * 10**5, 10**7), (10**10, 3 * 10**10, 10**11)])
def test_draws_by_either_way_follow_the_hypergeometric_law(spark, monkeypatch, n, k, t):
    """Mean, spread and shares of the ranges between quarter deviations, as the exact law has them."""
    low, high = max(0, n + k - t), min(n, k)
    mean, sd = n * k / t, (n * (k / t) * (1 - k / t) * (t - n) / (t - 1)) ** 0.5
    z = np.arange(max(low, int(mean - 9 * sd)), min(high, int(mean + 9 * sd)) + 1)[:: max(1, int(sd / 200))]
    lf = np.vectorize(math.lgamma)
    log = -(lf(z + 1.0) + lf(k - z + 1.0) + lf(n - z + 1.0) + lf(t - k - n + z + 1.0)) if t <= 10**7 else -((z - mean) ** 2) / (2 * sd**2)
    mass = np.exp(log - log.max())
    mass /= mass.sum()
    for most in (0, 10**9) if sd < 1_000 else (0,):
        monkeypatch.setattr(sharding, "MOST_STEPS", most)
        draw = sharding._hypergeometric(f"{n}L", f"{k}L", f"{t}L", "11", "id")
        got = np.array([r.x for r in spark.range(20_000).selectExpr(f"{draw} AS x").collect()])
        assert got.min() >= low and got.max() <= high
        assert abs(got.mean() - mean) < 4 * sd / 20_000**0.5 and abs(got.std() / sd - 1) < 0.03
        for q in (-1.5, -0.5, 0.0, 0.5, 1.5):
            assert abs((got <= mean + q * sd).mean() - mass[z <= mean + q * sd].sum()) < 0.02


def test_mixing(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ROWS) and all(r["__kept"] for r in got if not (r.text or "").strip()) and {r.tokens for r in got} == {"own"}
    assert len({r["__kept"] for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("most_cells", [mixing.DRIVER_CELLS, 0])
def test_mixing_keeps_the_targets_that_can_be_reached(spark, documents, most_cells):
    """One language has far fewer tokens than its target: it gives all, and the others what is missing."""
    rows = [(i, "word " * 50, "en" if i % 50 else "xx", f"s{i % 3}", 1) for i in range(600)]
    mixed = mixing.mix(documents(rows), targets={"lang": {"en": 0.5, "xx": 0.5}}, budget=0.5, most_cells=most_cells)
    langs = {r["__lang"]: r for r in mixing.marginals(mixed, "lang").collect()}
    assert langs["xx"].expected == pytest.approx(langs["xx"].tokens, rel=1e-5)
    assert langs["en"].expected == pytest.approx(0.5 * 30_000 - langs["xx"].tokens, rel=1e-5)
    for r in mixing.marginals(mixed, "source").collect():
        assert r.expected == pytest.approx(5_000, rel=1e-3)


def test_mixing_meets_targets_on_the_tables(spark, sf):
    mixed = mixing.mix(common.read(spark, sf, "documents", "doc_id", "text", "lang", "source"))
    for d in mixing.DIMENSIONS:
        rows = mixing.marginals(mixed, d).collect()
        tokens = np.array([r.tokens for r in rows], float)
        goal = mixing.reachable((tokens / tokens.sum()) ** mixing.TEMPERATURE, tokens, mixing.BUDGET * tokens.sum())
        assert np.allclose([r.expected for r in rows], goal, rtol=1e-4)
        assert sum(r.kept for r in rows) == pytest.approx(mixing.BUDGET * tokens.sum(), rel=0.2)


def test_urls(spark):
    rows = [(1, "http://x.com/en/1", None), (1, "http://x.com/en/1", None), (2, None, "<link rel=canonical href='http://x.com/en/1'>"), (3, "", ""), (4, "http://q.test/" + "a/" * 50_000, "<p>" * 90_000 + "<link rel=canonical href='http://x.com/en/1'>"), (None, "http://q.test/b", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *(f"'own' AS `{c}`" for c in CLASHES))
    got = sorted((r.page_id or 0, r.verdict, r.token) for r in urlfilter.judge(table).collect())
    assert got == [(0, "allow", "own"), (1, "block", "own"), (1, "block", "own"), (2, "allow", "own"), (3, "allow", "own"), (4, "block", "own")]


def test_nearest_with_lists_left_out(spark):
    """Recall where at most half of many lists are probed, over clustered vectors; ties go to the smaller id across parts."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16)) * 3
    x = np.round(centres[rng.integers(60, size=4_000)] + rng.standard_normal((4_000, 16)), 2)
    x[11] = x[10]
    table = spark.createDataFrame([(i, v.tolist(), "own") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "PROBE_SHARE", 0.5)
        patch.setattr(ann, "LEAST_LISTS", 64)
        patch.setattr(ann, "PART_ROWS", 30)
        got = collections.defaultdict(list)
        for r in ann.search(table).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({*np.lexsort((np.arange(len(x)), -s))[:20]} & {*found})
        if 10 in found and 11 in found:
            assert found.index(11) == found.index(10) + 1
    assert len(got) == 200 and hits / (200 * 20) > 0.9


def test_secrets(odd, empty):
    got = secrets.classify(odd).collect()
    assert len(got) == len(ROWS) and {r.value for r in got} == {"own"}
    assert [len(r.secrets) for r in got if r.doc_id == 7] == [1] and not any(r.secrets for r in got if r.doc_id != 7)
    assert {r.doc_id: r.text for r in secrets.redact(secrets.classify(odd)).collect()}[7] == "[SECRET] in the house"
    assert secrets.classify(empty).count() == 0


def test_secret_spans_of_equal_start_and_repeated_rows(documents):
    token = "a1b2c3d4" * 4
    rows = [(1, f"{token} secret={token}", "en", "a", 1)] * 3 + [(2, f"x {token}", "en", None, 1)]
    got = secrets.classify(documents(rows)).collect()
    assert {tuple((s.kind, s.start) for s in r.secrets) for r in got if r.doc_id == 1} == {((2, 0), (0, 33), (2, 40))}


def test_languages(odd, empty, documents):
    model = langid.fit(documents([(i, "the cat sat on the mat", "en", "a", 1) for i in range(20)] + [(i, "der hund lief im haus", "de", "a", 1) for i in range(20, 40)]))
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ROWS) and {r.token for r in got} == {"own"}
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id != 7} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 6: "en", 8: "und"}
    assert langid.identify(empty, model).count() == 0
    tied = langid.Model({"b": b"same text ", "a": b"same text "})
    assert tied.predict(["same text"]) == (["a"], [0.0])


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 1), (6, 0, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(odd, labels)
    got = toxicity.score(odd, index, evidence=True).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and {r.token for r in got} == {"own"}
    assert len({r.score for r in got if r.doc_id in (3, 4, 5, 8)}) == 1 and len({r.score for r in got if r.doc_id == 2}) == 1
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_jaccard(odd, empty):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.join(odd).collect())
    assert got == [(0, 7, 0), (1, 7, 1), (2, 6, 2), (2, 6, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 6, 6), (7, 2, 7), (8, 1, 8)]
    assert jaccard.join(empty).count() == 0


def test_levels_tell_frequent_tokens_from_noise_at_any_mean():
    rng = np.random.default_rng(7)
    for mean in (0.5, 20, 300, 50_000):
        noise = jaccard.levels(mean)[jaccard.coded(rng.poisson(mean, 20_000))]
        heavy = jaccard.levels(mean)[jaccard.coded(np.array([mean + 40 * (1 + mean**0.5), mean + 4_000 * (1 + mean**0.5)]))]
        assert (noise <= 2).mean() > 0.98 and noise.max() < heavy[0] < heavy[1]
    assert jaccard.levels(1.0)[jaccard.coded(np.array([0, 1]))].max() == 0 and jaccard.levels(1.0)[jaccard.coded(np.array([2]))] == 1


def test_group_of_near_copies_is_not_paired_with_itself(spark, documents, monkeypatch):
    """A hot group: all links are found although only some pairs are looked at."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for i in range(400):
        copy = base.copy()
        for k in rng.choice(160, rng.integers(0, 3), replace=False):
            copy[k] = f"x{rng.integers(10**6)}"
        docs.append((i, " ".join(copy), "en", "s", 1))
    looked = []
    verify = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *rest: (looked.append(pairs.count()), verify(pairs, *rest))[1])
    got = jaccard.join(documents(docs)).collect()
    assert {r.component_id for r in got} == {0} and sum(looked) < 400 * 20


def test_byte_bpe(odd, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    got = bpe.encode(odd, ranks, tokenizers.PATTERN).collect()
    assert collections.Counter(bytes(r.decoded).decode() for r in got) == collections.Counter(t or "" for _, t, *_ in ROWS)
    assert {r.token for r in got} == {"own"} and bpe.encode(empty, ranks, tokenizers.PATTERN).count() == 0


def test_quality(odd, empty):
    got = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert got[6].n_words == 180_000 and not got[6].kept and got[3].n_words == 0 and got[1].token == "own"
    assert quality.judge(empty).count() == 0


@pytest.mark.parametrize("stage", ["language_id", "ngram_jaccard", "secret_scan", "mixing_sources", "byte_bpe"])
def test_pipeline_stages(spark, odd, empty, sf, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    run = dict(pipeline.STAGES)[stage]
    got = run(spark, odd, sf)
    if stage != "byte_bpe":
        assert got.columns == odd.columns
        assert {r.token for r in got.collect()} <= {"own"}
    rows = collections.Counter(r.doc_id for r in got.collect())
    every = collections.Counter(r[0] for r in ROWS)
    if stage == "language_id":
        assert set(rows) == {1, 2, None, 6, 7}
    elif stage == "mixing_sources":
        assert rows.keys() <= every.keys() and {3, 4, 5} <= rows.keys()
    else:
        assert rows == every
    assert run(spark, empty, sf).count() == 0


def test_gaps_hold_places_of_any_distance():
    rng = np.random.default_rng(1)
    for places in ([], [0], [5, 6], [0, 65_534, 65_535, 65_536, 131_070, 196_605, 4_194_303], np.sort(rng.choice(1 << 22, 500, replace=False))):
        places = np.asarray(places, np.int64)
        assert (jaccard.places_of(pa.scalar(jaccard.gaps(places).tobytes(), pa.binary())) == places).all()
