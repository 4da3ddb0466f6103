"""Hard negatives and vector dedup against brute force, on hot groups and odd rows; and both against their SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import blocks, negatives, vectordedup

duckdb = pytest.importorskip("duckdb")
SCHEMA = "vec_id long, embedding array<float>, label int, block long, score double, v string"


def clustered(seed, n=700, width=12):
    """Rows of all kinds: a hot group of near copies, exact copies, clusters, and noise."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, width))
    x = centres[rng.integers(0, 20, n)] + rng.standard_normal((n, width)) * rng.choice([0.02, 0.3, 1.0], n)[:, None]
    x[: n // 3] = centres[0] + rng.standard_normal((n // 3, width)) * 0.05
    x[n // 3 : n // 3 + 40] = centres[1]
    label = np.where(np.arange(n) < n // 3, 3, rng.integers(0, 5, n))
    label[n // 3 : n // 3 + 40] = 4
    x = x.astype(np.float32)
    return [(i, [float(v) for v in x[i]], int(label[i]), 1, 0.5, "v") for i in rng.permutation(n).tolist()]


def odd(width=12):
    ok = [0.5] * width
    bad = [None, [], [0.0] * width, [math.nan] + ok[1:], [math.inf] + ok[1:], [None] + ok[1:], ok[:-1]]
    rows = [(9_000 + 100 * i, b, 1, 1, 0.5, "v") for i, b in enumerate(bad)] + [(9_901, ok, None, 1, 0.5, "v"), (None, ok, 1, 1, 0.5, "v"), (None, None, None, None, None, None)]
    return rows + [(10_000, ok, 1, 1, 0.5, "v")] * 2 + [(10_000, [-0.5] * width, 2, 1, 0.5, "v"), (10_001, [-0.0 + x for x in ok], 1, 1, 0.5, "v")]


def fits(r, zero=True):
    e = r[1]
    return r[2] is not None and e is not None and len(e) == 12 and all(x is not None and math.isfinite(x) for x in e) and (zero or any(e))


def negatives_of(rows, every):
    """By brute force, one row an id (the best where an id has several)."""
    fine = [(r[0], r[2], np.floor(256 * np.array(r[1], np.float64))) for r in rows if r[0] is not None and fits(r)]
    out = []
    for a in sorted({r[0] for r in fine if r[0] % every == 0}):
        _, label, v = min((r for r in fine if r[0] == a), key=lambda r: (r[1], list(r[2])))
        same, other = {}, {}
        for i, lab, w in fine:
            if i != a:
                into = same if lab == label else other
                into.setdefault(i, []).append(int(w @ v))
        for p, s in sorted(((i, max(v)) for i, v in same.items()), key=lambda x: (-x[1], x[0]))[:5]:
            near = sorted((-max(t for t in v if 80 * s <= 100 * t <= 100 * s), i) for i, v in other.items() if any(80 * s <= 100 * t <= 100 * s for t in v))[:5]
            out += [(a, p, k + 1, i, s, -t) for k, (t, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("block", [48, 1_024])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", 7)
    rows = clustered(1) + odd()
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA), 50).collect()))
    assert got == sorted(negatives_of(rows, 50))
    assert any(len({r[1] for r in got if r[0] == a}) > 1 for a in {r[0] for r in got})


def test_blocks_far_from_an_anchor_are_not_scanned(spark, monkeypatch):
    """Clusters far apart: the bound certifies after a share of the blocks."""
    rng = np.random.default_rng(2)
    centres = vectordedup.unit(rng.standard_normal((15, 12)))
    rows = [(i, [float(v) for v in centres[i % 15] + rng.standard_normal(12) * 0.02], i % 4) for i in range(2_000)]
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "GROUP", 4)
    product, seen = negatives.product, spark.sparkContext.accumulator(0)

    def counted(x, y):
        seen.add(len(x) * len(y))
        return product(x, y)

    monkeypatch.setattr(negatives, "product", counted)
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 100).collect()))
    assert got == sorted(negatives_of([(i, e, label) for i, e, label in rows], 100))
    assert 0 < seen.value < 0.5 * 2 * 20 * 2_000  # two searches of twenty anchors over all rows


def test_products_beyond_doubles_are_exact():
    x = np.array([[2.0**27 - 1, 3.0, -1.0], [2.0**27 - 3, 2.0**26 + 1, 5.0]])
    want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in x] for p in x]
    assert negatives.product(x, x).tolist() == want


def test_least_negative_is_the_least_long_that_passes(spark):
    scores = list(range(-3, 300)) + [2**62 + 7, 10**17 + 3]
    rows = spark.createDataFrame([(s,) for s in scores], "s long").select("s", negatives.least_negative(F.col("s")).alias("b")).collect()
    for s, b in rows:
        assert b > s if s < 0 else 80 * s <= 100 * b and 80 * s > 100 * (b - 1)


def links_of(rows, cosine):
    """n_links and component of each row by brute force."""
    fine = [i for i, r in enumerate(rows) if fits(r, zero=False)]
    x = np.array([rows[i][1] for i in fine], np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    labels = np.array([rows[i][2] for i in fine])
    near = (x @ x.T >= cosine) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    part = np.arange(len(fine))
    while True:
        then = np.array([min(part[j], *part[near[j]]) if near[j].any() else part[j] for j in range(len(fine))])
        if (then == part).all():
            break
        part = then
    out = [(r[0], 0, r[0]) for r in rows]
    for j, i in enumerate(fine):
        ids = [rows[fine[m]][0] for m in np.flatnonzero(part == part[j]) if rows[fine[m]][0] is not None]
        out[i] = (rows[i][0], int(near[j].sum()), min(ids, default=None))
    return [(*r, r[0] == r[2]) for r in out]


@pytest.mark.parametrize("block", [23, 2_048])
def test_dedup_is_that_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectordedup, "BLOCK", block)
    monkeypatch.setattr(vectordedup, "PAIRS", 500)
    rows = clustered(3) + odd()
    got = vectordedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    want = links_of(rows, vectordedup.COSINE)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len({r.component_id for r in got}) < len(got) and any(r.n_links > 200 for r in got)


@pytest.mark.parametrize("width", [2, 7, 64])
def test_codes_and_probes_lose_no_link(width):
    rng = np.random.default_rng(width)
    base = rng.standard_normal((150, width))
    x = vectordedup.unit(base[rng.integers(0, 150, 600)] + rng.standard_normal((600, width)) * rng.choice([0.02, 0.2, 0.5], 600)[:, None])
    model = vectordedup.Quantiser(x[:300], 30_000, 0.93)
    near, codes, error = model.coded(x)
    assert np.allclose(np.sqrt(((x - model.decoded(near, codes)) ** 2).sum(1)), error)
    want = set(zip(*(i.tolist() for i in np.nonzero(np.triu(x @ x.T >= 0.93, 1))), strict=True))
    got = [p for a, b in vectordedup.links_between(model, x, x, (near, near), codes, error, 0.93, True) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want) and len(model.lists) > 10
    half = vectordedup.links_between(model, x[:300], x[300:], (near[:300], near[300:]), codes[300:], error[300:], 0.93, False)
    assert {(i, j + 300) for a, b in half for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in want if i < 300 <= j}


def test_few_pairs_are_compared_on_vectors_themselves(monkeypatch):
    """Of vectors all around, codes leave hardly any but the linked ones."""
    rng = np.random.default_rng(8)
    base = vectordedup.unit(rng.standard_normal((1_500, 64)))
    x = np.concatenate([base, vectordedup.unit(base[:100] + rng.standard_normal((100, 64)) * 0.01)])
    model = vectordedup.Quantiser(x, len(x), 0.93)
    near, codes, error = model.coded(x)
    estimate = x @ model.decoded(near, codes).T
    passed = (estimate >= (1 + (model.decoded(near, codes) ** 2).sum(1) - (model.radius + error) ** 2) / 2 - vectordedup.SLACK).sum() - len(x)
    assert passed < 0.02 * len(x) ** 2


@pytest.mark.parametrize("module, query", [(negatives, "op12_hard_negatives"), (vectordedup, "op13_vector_dedup")])
def test_queries_agree_with_their_sql(spark, tmp_path, module, query):
    rows = [(r[0], r[1], r[2]) for r in clustered(4, 500)] + [(900 + i, e, lab) for i, (e, lab) in enumerate([(None, 1), ([math.nan] * 12, 1), ([0.0] * 12, None)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    frame = module.QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({module.SQL[query]})").fetchall()
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))


def test_no_rows_and_only_odd_rows(spark):
    for rows in ([], odd()[:8]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert negatives.mine(df).count() == 0
        out = vectordedup.dedup(df)
        assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == len(rows) and out.filter("n_links > 0 or not kept").count() == 0


def test_blocks_follow_the_order_and_hold_one_value(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(1_000)], "kind long, i long")
    parts = blocks.in_blocks(df, ["kind", "i"], 30, 1_000, "kind").groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), (F.max("i") - F.min("i")).alias("span")).collect()
    assert sum(r.n for r in parts) == 1_000 and all(r.n <= 30 and r.kinds == 1 and r.span == 7 * (r.n - 1) for r in parts)
