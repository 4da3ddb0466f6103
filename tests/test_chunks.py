"""The chunker against a plain brute-force splitter, its laws, and groups of rows."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.sources import chunks


def pieces_at(text, mark, keep):
    if mark == "":
        return [*text]
    cuts = [i for i in range(len(text)) if text.startswith(mark, i)] if keep else []
    if keep:
        return [text[a:z] for a, z in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < z]
    return [p for p in text.split(mark) if p]


def by_hand(text, marks, size, overlap, keep):
    """All pieces first, then every window by trying starts one by one."""
    mark = next(m for m in marks if m in text)
    rest, out, run = marks[marks.index(mark) + 1 :], [], []
    glue = "" if keep else mark

    def windows(run):
        lo = 0
        while lo < len(run):
            hi = lo + 1
            while hi < len(run) and sum(map(len, run[lo:hi])) + (hi - lo) * len(glue) + len(run[hi]) <= size:
                hi += 1
            out.append(glue.join(run[lo:hi]))
            if hi == len(run):
                return
            fits = lambda a: sum(map(len, run[a:hi])) <= overlap and sum(map(len, run[a:hi])) + (hi - a) * len(glue) + len(run[hi]) <= size  # noqa: B023, E731
            lo = next(a for a in range(lo, hi + 1) if a == hi or fits(a))

    for p in [*pieces_at(text, mark, keep), None]:
        if p is not None and len(p) < size:
            run.append(p)
            continue
        windows(run)
        run = []
        if p is not None:
            out += by_hand(p, rest, size, overlap, keep) if mark else [p]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_chunks_are_those_of_a_brute_force_splitter(seed):
    rng = random.Random(seed)
    bits = ["\n\n", "\n", " ", "a", "bc", "word", "é日本", "\n## ", "\n### head", "```\n\n", "\n\n***\n\n", "x" * 12, "\n\n\n"]
    text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 120)))
    size = rng.randint(5, 40)
    overlap = rng.randint(0, size - 1)
    for extension, marks, keep in ((".txt", chunks.PLAIN, True), (".MD", chunks.MARKDOWN, False)):
        want = [c for c in (c.strip() for c in by_hand(text, marks, size, overlap, keep)) if c]
        assert list(chunks.chunks_of(text, extension, size, overlap)) == want


def test_laws_of_chunks(spark):
    body = "# A\n" + "word " * 5_000 + "\n## B\nshort\n" + "y" * 4_000
    rows = chunks.chunked(spark.createDataFrame([(1, body, ".txt"), (2, "", ".md"), (3, None, None), (4, " \n ", ""), (5, body, ".md")], "id int, text string, suffix string"), extension="suffix").orderBy("id", "chunk_index").collect()
    assert {r.id for r in rows} == {1, 5} and all(0 < len(r.chunk) <= 1000 and r.chunk == r.chunk.strip() for r in rows)
    plain = [r for r in rows if r.id == 1]
    assert [r.chunk_index for r in plain] == list(range(len(plain))) and all(r.chunk in body for r in plain)
    at = [body.find(r.chunk[:990]) for r in plain]
    assert at == sorted(at)
    assert any(r.chunk.startswith("B\nshort") for r in rows if r.id == 5) and any("## B\nshort" in r.chunk for r in plain)


def test_rows_fill_a_part_before_the_next_begins(spark):
    rng = random.Random(4)
    rows = [(g, n, "z" * rng.randint(1, 90)) for g in range(5) for n in range(rng.randint(1, 60))] + [(9, 0, "q" * 500)]
    want = {}
    for g in {r[0] for r in rows}:
        parts, length = [], 30
        for _, n, line in (r for r in rows if r[0] == g):
            if parts and length + 1 + len(line) <= 200:
                parts[-1].append(line)
                length += 1 + len(line)
            else:
                parts.append([line])
                length = 30 + len(line)
        want[g] = ["\n".join(p) for p in parts]
    rng.shuffle(rows)
    got = chunks.grouped_rows(spark.createDataFrame(rows, "g long, n long, line string"), "g", "n", "line", 30, 200).orderBy("g", "part").collect()
    assert {g: [r.text for r in got if r.g == g] for g in want} == want
    assert all(r.last - r.first + 1 == r.text.count("\n") + 1 for r in got)


def test_chunks_join_laterally_without_an_exchange(spark):
    plan = chunks.chunked(spark.range(5).select(F.col("id").cast("string").alias("text")))._jdf.queryExecution().toString()
    assert "BatchEvalPythonUDTF" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
