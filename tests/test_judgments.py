"""Judgments by paths, ends and globs against a nested loop, and feedback against a fold in order."""

import random
import re

from corvane.functions.text import glob_pattern
from corvane.operators import judgments


def test_paths_are_met_as_by_a_nested_loop(spark):
    rng = random.Random(1)
    words = ["a", "b", "src", "x.md", "y.md", "y.txt", "z", ".h", "a*b", "1.md", "noext"]
    paths = sorted({"/".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    patterns = ["x.md", "src/x.md", "a", "/a", "", "**", "**/*.md", "*.md", "src/**", "src/**/*.md", "*/x.md", "**/y.*", "{a,b}/x.md", "{a/x,b/y}.md", "a/{b,src}/*.md", "[ab]/*", "?.md", "*/*", "a*b", "[!a]*/z", "**/noext", "b/?oext", *paths[:15]]
    want = {(p, g) for p in paths for g in patterns if p == g or p.endswith("/" + g) or (re.search(judgments.GLOB, g) and re.search(glob_pattern(g), p))}
    frame = judgments.matched(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g,) for g in patterns], "pattern string"), "path", "pattern")
    assert {tuple(r) for r in frame.collect()} == want and frame.count() == len(want) > 200
    plan = frame._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_feedback_is_folded_in_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 6), rng.randint(0, 3), rng.choice(["relevant", "irrelevant", "stale", "misleading"]), rng.randint(0, 3), [rng.choice("abc")] if rng.random() < 0.7 else None) for i in range(60)] + [(99, 50, 0, "relevant", 2, None)]
    positive, negative = {}, {}
    for i, source, relevance, verdict, created, groups in rows:
        if relevance > 0 and verdict == "relevant":
            old = positive.get(source)
            stronger = old is None or (relevance, created) >= (old[0], old[1])
            positive[source] = ((relevance, created, i) if stronger else old[:3]) + ((set(groups or ()) | (old[3] if old else set())),)
            negative.pop(source, None)
        elif source not in positive and (source not in negative or created >= negative[source][0]):
            negative[source] = (created, i)
    want = {s: (True, r, i, sorted(g)) for s, (r, _, i, g) in positive.items()} | {s: (False, None, i, None) for s, (_, i) in negative.items()}
    df = spark.createDataFrame(rows, "n int, source int, relevance int, verdict string, created int, groups array<string>")
    got = {r.source: (r.required, r.relevance, r.decided_by, r.groups) for r in judgments.promoted(df, ["source"], "created", "n").collect()}
    assert got == want and {w[0] for w in want.values()} == {True, False}
