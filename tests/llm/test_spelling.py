"""Spelling variants against all one-edit pairs by brute force, and against their SQL on odd rows."""

import random
from itertools import pairwise

import pytest

from corvane.llm import spelling

duckdb = pytest.importorskip("duckdb")


def all_pairs(words):
    there, letters, out = set(words), {c for w in words for c in w}, set()
    for w in words:
        for i in range(len(w) + 1):
            longer = {w[:i] + c + w[i:] for c in letters} & there
            same = {w[:i] + c + w[i + 1 :] for c in letters if i < len(w) and c != w[i]} & there
            out |= {(w, x) for x in longer | same} | {(x, w) for x in longer}
    return out


@pytest.mark.parametrize("seed", range(40))
def test_parts_of_a_trie_give_every_pair_once(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc", "abcdé"])
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(2, 200))})
    cuts = sorted(rng.sample(range(1, len(words)), min(rng.randint(0, 8), len(words) - 1)))
    parts = [words[a:b] for a, b in pairwise([0, *cuts, len(words)])]
    heavy = spelling.heavy_letters([(p[0], p[-1], spelling._spine(p, p[0]), spelling._spine(p[::-1], p[-1])) for p in parts])
    found, siblings, strings = [], {}, 0
    for p in parts:
        for kind, i, x in spelling.merged(p, heavy):
            strings += 1
            if kind == spelling.PAIR:
                found += [(p[i], p[x]), (p[x], p[i])]
            elif kind == spelling.WILDCARD:
                siblings.setdefault(x, []).append(p[i])
            elif x in words:
                found += [(p[i], x), (x, p[i])]
    found += [(a, b) for g in siblings.values() for a in g for b in g if a != b]
    assert len(found) == len(set(found))
    assert set(found) == all_pairs(words)
    assert strings <= 3 * len(words) * max(1, len(words).bit_length()) + len(found)


def test_many_parts_on_spark_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 7))): int(5 * 10 ** rng.uniform(0, 5)) for _ in range(900)}
    words |= {"x" * 3_000 + c: 7 for c in "abc"}
    near = {}
    for a, b in all_pairs(list(words)):
        near.setdefault(a, []).append((-words[b], b))
    form = {w: min(near[w])[1] if w in near and -min(near[w])[0] >= 5 * n else None for w, n in words.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    want = sorted((w, form[w] or "", root(w), n, len(near.get(w, ())), words.get(form[w], 0)) for w, n in words.items())
    assert any(form[form[w]] for w in words if form[w])
    monkeypatch.setattr(spelling, "PART_WORDS", 60)
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in rows) == want


def test_odd_documents_agree_with_their_sql(spark, tmp_path):
    rng = random.Random(6)
    stems = ["éclairée", "straßen", "Zebrafish", "NAÏVETÉ", "hot×cold÷x", "colour", "coloour", "aaaaaa", "aaaaaaa", "abcdef", "abcdeg"]
    texts = [None, "", "  \n", "12 34 --", "日本語", " ".join(rng.choices(stems, k=20_000))] + [" ".join(rng.choices(stems, k=60)) for _ in range(300)]
    rows = [(None if i % 11 == 0 else i, t, "n", 1, "w") for i, t in enumerate(texts + texts[:9])]
    spark.createDataFrame(rows, "doc_id long, text string, word string, n long, key string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spelling.op11_spelling_variants(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({spelling.SQL['op11_spelling_variants']})").fetchall()
    got = [tuple(r) for r in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(r[1] for r in got) and len({r[2] for r in got}) < len(got)


def test_no_documents_and_no_words(spark):
    schema = "doc_id long, text string"
    for rows in ([], [(1, None), (2, "short words go")]):
        out = spelling.variants(spelling.count_words(spark.createDataFrame(rows, schema), spelling.ERRATA))
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
