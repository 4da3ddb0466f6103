"""Spelling variants: words at one edit from each other, by merging the light subtrees of a trie over all words.

Words are sorted by ranges, so that each part holds whole subtrees of the trie but for the nodes on its borders. A node's
heavy child is the one with most words. For every word and every node where it leaves the heavy path, the light subtree is
merged into the node with the branching character replaced (by the heavy one, or by a wildcard that light siblings share),
skipped, or with the heavy one put before it; a merged string that coincides with a word's, or with a sibling's, is a pair.
Every pair parts at one node and one of its words is light there, so each pair is found, and found once; a word
leaves at most log2(words) heavy paths, so at most three times as many strings are merged for each.

Nodes that lie within a part are merged where they are. Those that span parts (the prefixes that words on both sides of a
border share) get their heavy child from counts that each part sends, one row a part, and their merged strings are exchanged
and joined with the words; a wildcard string is shared by at most as many words as there are letters.

Defined results: null texts hold no words, a null ``doc_id`` counts as an empty one, repeated documents count as often as
they occur, ties of equal counts go to the smaller word by code points. Words of any length are fine. Extra columns don't
matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run of a document in so many loses a letter in the query, so that there are variants to find.
ERRATA = 199
#: Words of a part.
PART_WORDS = 20_000
#: Kinds of rows that a part sends on: a pair, a string to look up among all words, one to meet those of siblings.
PAIR, LOOK_UP, WILDCARD = 0, 1, 2
#: Stands for the replaced letter; no run holds it.
ANY = "*"


def count_words(docs: DataFrame, errata: int | None = None) -> DataFrame:
    """(word, n) of whole ``text``s, of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences.

    ``errata``: where it divides the crc32 of ``<doc_id>:<run>``, the run loses the letter at crc32 modulo its length.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), 0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    if errata:
        h, word = F.crc32(F.concat("id", F.lit(":"), "word")), F.col("word")
        at = (h % F.length(word)).cast("int")
        word = F.when(h % errata == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
        runs = runs.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def shared_prefix(a: str, b: str) -> int:
    """Letters that two words begin with together."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    return next(i for i in range(most) if a[i] != b[i])


def _spine(words: list[str], end: str) -> list[tuple[int, str, int]]:
    """How many words leave the path to ``end`` at which depth by which letter; ``words`` begin with ``end`` and go away from it."""
    found: dict[tuple[int, str], int] = {}
    depth, before = len(end), end
    for w in words:
        depth = min(depth, shared_prefix(before, w))
        key = (depth, w[depth : depth + 1])
        found[key] = found.get(key, 0) + 1
        before = w
    return [(d, c, k) for (d, c), k in found.items()]


SUMMARY = "part int, first string, last string, n long, depths array<int>, letters array<string>, counts array<long>, right int"


def _summary(table: pa.Table) -> pa.Table:
    words = sorted(table.column("word").to_pylist())
    left, right = _spine(words, words[0]), _spine(words[::-1], words[-1])
    both = left + right
    return pa.table({
        "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "first": [words[0]], "last": [words[-1]], "n": [len(words)],
        "depths": pa.array([[d for d, _, _ in both]], pa.list_(pa.int32())), "letters": pa.array([[c for _, c, _ in both]], pa.list_(pa.string())),
        "counts": pa.array([[k for _, _, k in both]], pa.list_(pa.int64())), "right": pa.array([len(left)], pa.int32()),
    })


def heavy_letters(parts: list[tuple[str, str, list, list]]) -> dict[str, str]:
    """The heavy letter of every node that spans parts: ``parts`` has (first, last, left spine, right spine) of each, in order."""
    before = [0] + [shared_prefix(a[1], b[0]) for a, b in pairwise(parts)] + [0]
    nodes: set[str] = set()
    for p, (first, last, left, right) in enumerate(parts):
        if p:
            nodes.add(first[: before[p]])
            nodes.update(first[:d] for d, _, _ in left if d <= before[p])
        if p + 1 < len(parts):
            nodes.update(last[:d] for d, _, _ in right if d <= before[p + 1])
    depths = sorted({len(u) for u in nodes})
    weights: dict[str, dict[str, int]] = {u: {} for u in nodes}
    for p, (first, last, left, right) in enumerate(parts):
        shared = shared_prefix(first, last)
        for end, spine, most, least in ((first, left, before[p], -1), (last, right, before[p + 1], min(shared, before[p]))):
            for d in (d for d in depths if least < d <= most and end[:d] in weights):
                into = weights[end[:d]]
                for depth, letter, k in spine:
                    if depth >= d:
                        c = letter if depth == d else end[d]
                        into[c] = into.get(c, 0) + k
    return {u: min((-k, c) for c, k in w.items() if c)[1] for u, w in weights.items() if len(w) > 1}


def _nodes(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(depth, where each child begins and the last one ends) of every node of sorted words at which some part."""
    open_: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        depth = shared_prefix(words[i - 1], words[i]) if i < len(words) else -1
        start = i - 1
        while open_ and open_[-1][0] > depth:
            d, starts = open_.pop()
            yield d, [*starts, i]
            start = starts[0]
        if i < len(words):
            if open_ and open_[-1][0] == depth:
                open_[-1][1].append(i)
            else:
                open_.append((depth, [start, i]))


def merged(words: list[str], heavy: dict[str, str]) -> Iterator[tuple[int, int, object]]:
    """The rows of a part of sorted words: (PAIR, i, j) of two of them, or (LOOK_UP or WILDCARD, i, merged string)."""
    where = {w: i for i, w in enumerate(words)}

    def strings(i: int, d: int, h: str) -> Iterator[tuple[int, str]]:
        w = words[i]
        if w[d : d + 1]:
            yield WILDCARD, w[:d] + ANY + w[d + 1 :]
            yield LOOK_UP, w[:d] + h + w[d + 1 :]
            if w[d + 1 : d + 2] != w[d]:  # else the string parts from the word further down
                yield LOOK_UP, w[:d] + w[d + 1 :]
        yield LOOK_UP, w[:d] + h + w[d:]

    spanning = {(d, w[:d]) for w in words[:1] + words[-1:] for d in {len(u) for u in heavy} if d <= len(w) and w[:d] in heavy}
    for d, u in spanning:
        h = heavy[u]
        for i, w in enumerate(words):
            if w.startswith(u) and w[d : d + 1] != h:
                for kind, key in strings(i, d, h):
                    yield kind, i, key
    for d, starts in _nodes(words):
        if (d, words[starts[0]][:d]) in spanning:
            continue
        children = list(pairwise(starts))
        h = words[max((c for c in children if len(words[c[0]]) > d), key=lambda c: (c[1] - c[0], -c[0]))[0]][d]
        siblings: dict[str, list[int]] = {}
        for begin, end in children:
            if words[begin][d : d + 1] == h:
                continue
            for i in range(begin, end):
                for kind, key in strings(i, d, h):
                    if kind == WILDCARD:
                        for j in siblings.get(key, ()):
                            yield PAIR, i, j
                        siblings.setdefault(key, []).append(i)
                    elif (j := where.get(key)) is not None:
                        yield PAIR, i, j


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, other, other_n) for every two of the distinct ``words`` (word, n) at exactly one edit, both ways."""
    parts_n = max(1, -(-words.count() // PART_WORDS))
    sorted_ = scratch.cut(words.repartitionByRange(parts_n, "word").sortWithinPartitions("word").select("word", "n", F.spark_partition_id().alias("part")))
    rows = sorted_.groupBy("part").applyInArrow(_summary, SUMMARY).orderBy("part").collect()  # one row a part
    spine = lambda r, a, b: list(zip(r.depths[a:b], r.letters[a:b], r.counts[a:b], strict=True))
    heavy = heavy_letters([(r.first, r.last, spine(r, 0, r.right), spine(r, r.right, None)) for r in rows])
    shared = words.sparkSession.sparkContext.broadcast(heavy)  # the nodes on borders of parts

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        names, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
        kinds, keys, at, others = [], [], [], []
        for kind, i, x in merged(names, shared.value):
            for a, b in ((i, x), (x, i)) if kind == PAIR else ((i, None),):
                kinds.append(kind)
                keys.append(x if b is None else names[b])
                at.append(a)
                others.append(None if b is None else counts[b])
        at = pa.array(at, pa.int64())
        return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.string()), "word": table.column("word").take(at), "n": table.column("n").take(at), "key_n": pa.array(others, pa.int64())})

    strings = scratch.cut(sorted_.groupBy("part").applyInArrow(merge, "kind int, key string, word string, n long, key_n long"))
    within = strings.filter(F.col("kind") == PAIR).select("word", F.col("key").alias("other"), F.col("key_n").alias("other_n"))
    met = strings.filter(F.col("kind") == LOOK_UP).select("key", "word", "n").join(sorted_.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    one_way = met.select("word", F.col("key").alias("other"), F.col("key_n").alias("other_n"))
    other_way = met.select(F.col("key").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    groups = strings.filter(F.col("kind") == WILDCARD).groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("all")).filter(F.size("all") > 1)  # at most one a letter
    siblings = groups.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).filter(F.col("a.word") != F.col("b.word"))
    siblings = siblings.select(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
    return within.unionByName(one_way).unionByName(other_way).unionByName(siblings)


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form) by jumps of doubling length; a form has more occurrences than its word, so there are no circles."""
    current = scratch.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        then = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = scratch.cut(current.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not jumped.filter("moved").isEmpty()
        scratch.drop(current)
        if not moved:
            return jumped.select("word", "root")
        current = jumped.drop("moved")
        current._scratch_path = jumped._scratch_path


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """For each of the distinct ``words`` (word, n): its form, the root that forms lead to, and how many words are near."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.cut(words)
    best = near_words(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    often = -F.col("best.less") >= F.col("n") * ratio
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    told = scratch.cut(told)
    roots = roots_of(told.filter(F.col("form").isNotNull()), scratch)
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return variants(count_words(read(spark, sf_dir, "documents", "doc_id", "text"), ERRATA))


#: The crc32 is folded over bytes by its table, which a recursion makes; near words share a string that lacks one letter.
_SQL = """
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
docs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+') AS runs FROM documents WHERE text IS NOT NULL),
runs AS (SELECT id, run, count(*) AS k FROM (SELECT id, unnest(runs) AS run FROM docs) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT id, run, k, hex(encode(id || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i::INT + 1, 2))::BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, tab),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(struct_pack(o := other, n := other_n) ORDER BY other_n DESC, other) AS b FROM near GROUP BY word),
told AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.o END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best USING (word)),
paths(word, last, steps) AS (SELECT word, word, 0 FROM told UNION ALL SELECT p.word, t.form, steps + 1 FROM paths p JOIN told t ON p.last = t.word WHERE t.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, steps) AS root FROM paths GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM told JOIN roots USING (word)
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL = {"op11_spelling_variants": _SQL}
