"""High-recall rules and questions asked part by part, against loops over one query at a time."""

import math
import random

from corvane.operators import recall


def filtered(query, rows, k, cap=3):
    """One query's candidates in order of rank: id -> (reason, neighbour, relaxed)."""
    anchors = [w for w in query.lower().split() if len(w) >= 3 and w != "the"]
    seen, counts, kept, out = set(), {}, [], {}
    for i, source, at, body, _rank, lexical in rows:
        mark = (source, " ".join(body.lower().split())[:800])
        if mark in seen:
            out[i] = "duplicate_collapse"
        elif counts.get(source, 0) >= cap and len(kept) >= k:
            out[i] = "source_diversity_cap"
        else:
            counts[source] = counts.get(source, 0) + 1
            kept.append((i, source, at, body, lexical))
        seen.add(mark)
    sure = {(s, at) for _, s, at, body, lexical in kept if lexical or any(a in f"{body} {s}".lower() for a in anchors)}
    near = {i for i, s, at, *_ in kept if (s, at) not in sure and ((s, at - 1) in sure or (s, at + 1) in sure)}
    left = [c for c in kept if (c[1], c[2]) in sure or c[0] in near]
    relaxed = bool(anchors) and len(left) < min(k, len(kept))
    for c in kept:
        out[c[0]] = None if relaxed or not anchors or c in left else "anchor_filter"
    return {i: (r, i in near and not relaxed and bool(anchors), relaxed) for i, r in out.items()}


def test_high_recall_is_the_loop_over_each_query(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q, (query, k) in enumerate([("fox the", 4), ("zebra", 4), ("", 4), ("bear fox", 4), ("ｆｏｘ", 4)] * 6):
        at = {}
        mine = []
        for r in range(30):
            s = f"s{rng.randint(0, 5)}"
            at[s] = at.get(s, 0) + 1
            body = rng.choice(["red fox  runs", "Red FOX runs", "blue", f"plain {rng.randint(0, 3)}", f"a bear {r}", f"words {r}"])
            mine.append((f"{q}-{r}", s, at[s], body, r + 1, rng.random() < 0.05))
        rows += [(q, query, *m) for m in mine]
        want |= filtered("fox" if query == "ｆｏｘ" else query, mine, k)
    df = spark.createDataFrame(rows, "query_id int, query string, id string, source string, chunk_index int, text string, rank int, lexical boolean")
    got = {r.id: (r.reason, r.neighbour, r.relaxed) for r in recall.high_recall(df, 4).collect()}
    assert got == want
    assert {r for r, *_ in want.values()} == {None, "duplicate_collapse", "source_diversity_cap", "anchor_filter"} and {n for _, n, _ in want.values()} == {True, False} and {x for *_, x in want.values()} == {True, False}


def test_questions_are_taken_apart(spark):
    cases = {
        "What is red and what is blue?": ["What is red and what is blue?", "What is red", "what is blue?"],
        "difference between apples and pears?": ["difference between apples and pears?", "difference between apples", "pears?", "apples"],
        "  plain  question ": ["plain question"],
        "a AND A then a": ["a AND A then a", "a"],
        "": [],
        "one and two and three and four and five": ["one and two and three and four and five", "one", "two", "three"],
    }
    rows = recall.subqueries(spark.createDataFrame(list(enumerate(cases)), "q int, t string"), "q", "t").orderBy("query_id", "part").collect()
    for q, (_, parts) in enumerate(cases.items()):
        assert [r.subquery for r in rows if r.query_id == q] == parts


def ask(question, parts, planned, hits, k, most):
    share, total, evidence, stop, iterations = math.ceil(most / len(parts)), 0, {}, "exhausted_subqueries", 0
    for p in range(len(parts)):
        if total >= most:
            stop = "max_total_candidates"
            break
        found = hits.get(p, [])[: min(max(1, most - total), share)]
        total, iterations = total + len(found), iterations + 1
        for i, body in found:
            evidence.setdefault(i, [p, 0, body])[1] += 1
        held = " ".join(b for *_, b in evidence.values()).lower()
        if all(any(w in held for w in a.lower().split() if len(w) >= 3) for a in planned):
            stop = "sufficient"
            break
        if total >= most:
            stop = "max_total_candidates"
            break
    if stop == "exhausted_subqueries" and len(parts) >= 4 and iterations < len(planned) + 1:
        stop = "max_subqueries"
    order = sorted(evidence, key=lambda i: (evidence[i][0] == 0 and evidence[i][1] == 1, -evidence[i][1]))
    return [(i, evidence[i][1], evidence[i][0], iterations, stop) for i in order[:k]]


def test_asking_part_by_part_is_the_loop_over_each_question(spark):
    rng = random.Random(2)
    words = "lion bear wolf deer hare crow dove swan".split()
    questions = [(q, " and ".join(rng.sample(words, rng.randint(1, 5)) + (["unknown"] if q % 4 == 0 else []))) for q in range(40)]
    df = spark.createDataFrame(questions, "q int, t string")
    parts = recall.subqueries(df, "q", "t")
    named = {}
    for r in parts.orderBy("query_id", "part").collect():
        named.setdefault(r.query_id, []).append(r.subquery)
    rows, want = [], {}
    for q, t in questions:
        hits = {p: [(i, rng.choice([rng.choice(words), "nothing"]) + f" {i}") for i in rng.sample(range(12), rng.randint(0, 8))] for p in range(len(named[q]))}
        hits = {p: [(i, f"{words[(i * 3 + q) % 8] if i % 3 else 'nothing'}") for i, _ in h] for p, h in hits.items()}
        rows += [(q, p, n + 1, i, b) for p, h in hits.items() for n, (i, b) in enumerate(h)]
        planned = t.split(" and ") if " and " in t else [t]
        want[q] = ask(t, named[q], planned, hits, 6, 12)
    hits = spark.createDataFrame(rows, "query_id int, part int, rank int, id int, text string")
    got = {q: [] for q, _ in questions}
    for r in recall.gathered(df, "q", "t", parts, hits, 6, 12).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.times, r.first_part, r.iterations, r.stop))
    assert got == want
    assert {r[-1] for w in want.values() for r in w} == {"sufficient", "max_total_candidates", "exhausted_subqueries", "max_subqueries"}
