"""Operators that judge rows one by one: secrets, language, BPE, quality."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane.llm import bpe, langid, quality, secrets

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, " \t\n ", "en", "a", 4),
    (None, "the plain words", "en", "a", 15),
    (5, "x" * 50_000 + " the " + "ab " * 20_000, "fr", "b", 0),
    (6, "tie tie", "en", "a", 7),
    (6, "tie tie", "en", "a", 7),
]


def brute_spans(text):
    """The contract read literally: all matches, then those that fail the length dropped."""
    text = text or ""
    found = []
    for m in re.finditer(secrets.ASSIGN, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_base_spans_match_brute_force(spark, sf):
    got = {r.doc_id: r for r in secrets.op5_secret_scan(spark, sf).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    for row in rows:
        base = brute_spans(row["text"])
        assert got[row["doc_id"]].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[row["doc_id"]].spans.split(","))


def test_secret_ownership_separates_copies_from_live_ones(spark, documents):
    shared, own = "Ab3" * 8, "Zx9" * 8
    rows = [(i, f"key {shared} end", "en", f"s{i}", 1) for i in range(6)] + [(100, f"key {own} token = abcdef1 é", "en", "s1", 1)]
    got = {r.doc_id: r.secrets for r in secrets.classify(documents(rows)).collect()}
    assert got[0] == []
    assert [(s.kind, s.live) for s in got[100]] == [(3, True), (0, True)]
    text = {r.doc_id: r.text for r in secrets.redact(secrets.classify(documents(rows))).collect()}
    assert text[0] == rows[0][1] and text[100] == "key [SECRET] [SECRET] é"


def test_secret_of_one_owner_is_live_in_however_many_documents(spark, documents):
    token = "Ab3" * 8
    rows = [(i, f"key {token} end", "en", "hot", 1) for i in range(40)]
    assert {r.text for r in secrets.redact(secrets.classify(documents(rows))).collect()} == {"key [SECRET] end"}
    assert all(r.secrets == [] for r in secrets.classify(documents(rows), repository="doc_id").collect())


def test_secret_odd_rows(spark, documents):
    got = secrets.redact(secrets.classify(documents(ODD))).collect()
    assert sorted(map(str, got)) == sorted(map(str, documents(ODD).collect()))
    assert secrets.classify(spark.createDataFrame([], EMPTY)).count() == 0
    clash = documents([(1, "password: hunter22", "en", "a", 1)]).selectExpr("*", "lang as value", "lang as kind")
    assert secrets.classify(clash).collect()[0].secrets[0].end == 18


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    got = [r for r in langid.op6_language_id(spark, sf).collect() if r.held_out]
    assert len(got) > 150
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.95


def test_phrases_match_brute_force_cross_parsing():
    samples = {"a": b"the cat sat on the mat ", "b": b"le chat est sur le tapis "}
    model = langid.Model(samples)
    texts = ["the cat", "le chat noir", "zzz", "sat sur mat tapis " * 100]
    got = model.phrases(texts)
    for i, t in enumerate(texts):
        flat = langid.symbols([t])[0].tobytes()
        for j, x in enumerate(model.languages):
            n = p = 0
            while p < len(flat):
                e = p + 1
                while e < len(flat) and flat[p : e + 1] in samples[x]:
                    e += 1
                p, n = e, n + 1
            assert got[i, j] == n


def test_lanes_of_any_length_give_the_same_phrases(monkeypatch):
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("abc "), n))
    model = langid.Model({"a": letters(400).encode(), "b": letters(400).encode(), "c": b"cab"})
    texts = [letters(n) for n in (0, 1, 7, 40, 900, 5_000)]
    whole = model.phrases(texts)
    for lane in (1, 2, 3, 16, 10_000):
        monkeypatch.setattr(langid, "LANE", lane)
        assert (model.phrases(texts) == whole).all()


def test_languages_beyond_one_group_are_learned(spark, documents):
    names = [f"l{i:02}" for i in range(70)]
    text = lambda i: " ".join(chr(0x4E00 + 40 * i + k) * 3 for k in range(30))
    docs = [(100 * i + k, text(i), names[i], "a", 1) for i in range(70) for k in range(3 if i == 69 else 4)]
    model = langid.fit(documents(docs))
    assert model.languages == names
    got = langid.identify(documents([(i, text(i), None, "a", 1) for i in range(70)]), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == names


def test_language_odd_rows(spark, documents):
    model = langid.fit(documents([(i, "the cat sat", "en", "a", 1) for i in range(20)] + [(i, "der hund lief", "de", "a", 1) for i in range(20, 40)] + ODD))
    got = langid.identify(documents(ODD), model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    nothing = langid.fit(spark.createDataFrame([], EMPTY))
    assert {r.lang_pred for r in langid.identify(documents(ODD), nothing).collect()} == {"und"}


def test_bpe_matches_tiktoken(spark, documents):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] for r in ODD] + ["aaaa" * 99, "日本語 😀😀", "don't I'll  \n\n x", "abcabcabcab" * 30, "<|endoftext|>"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    for r in bpe.encode(documents(rows), ranks, tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == own.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.n_tokens * 4 == len(r.ids)
    assert bpe.encode(spark.createDataFrame([], EMPTY), ranks, tokenizers.PATTERN).count() == 0


def test_replay_takes_a_lower_new_pair_before_the_rest():
    ranks = {bytes([b]): b for b in range(256)} | {b"abx": 256, b"ab": 257, b"xab": 258}
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    v = bpe.Vocabulary(ranks)
    for word in (b"abxab", b"xabxab", b"abab", b"abxabxab", b"ab" * 9 + b"x"):
        assert v.replay([word])[0] == own.encode_ordinary(word.decode())


def test_quality_odd_rows(spark, documents):
    got = {(r.doc_id, r.n_chars): r for r in quality.judge(documents(ODD)).collect()}
    assert got[1, 0].n_words == 0 and got[1, 0].base_failed and not got[1, 0].kept
    assert got[5, 0].n_words == 20_002 and got[5, 0].n_repeat_words == 20_000
    assert quality.judge(spark.createDataFrame([], EMPTY)).count() == 0


def test_quality_repeats_by_brute_force(spark, documents):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c"], n)) for n in (5, 8, 9, 30, 60)] + ["one two three four five six seven eight nine " * 3]
    for r in quality.judge(documents([(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect():
        w = texts[r.doc_id].split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        assert r.n_repeat_words == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)})
