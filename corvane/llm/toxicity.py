"""Toxicity by the nearest labelled examples, found by exact TF-IDF cosine in a block-max inverted index.

Terms are lower-cased words, and the first letters of longer words. The index holds labelled examples as blocks; for each
term it keeps the greatest weight in each block. Terms of many examples are scored for all examples of a batch of queries
by one matrix product; with the bounds of the rarer terms this bounds every block from above, and gives the least score
that a neighbour must beat. Blocks are then scored exactly, best bound first, and the least score rises after each step,
until no bound reaches it. The neighbours vote with their similarity as weight; the vote is turned into a probability by a
logistic curve fitted on the examples' own votes with each example left out, where the rarer label weighs more by the root
of the labels' ratio. Neighbours, similarities and labels are the evidence.

The examples are a bounded sample of the labelled rows outside the held-out fold: at most ``TOXIC`` and ``CLEAN`` of them
(smallest id hashes), as counts of the terms of their whole texts. The vocabulary is all of their terms. Queries are whole
texts.

Defined results: texts without a known term (null and empty ones too) get the score of no vote. Texts of any length are
scored whole. Labels with nulls teach nothing, nor do examples without a text; documents that are labelled both ways teach
by their least label; of rows that share an id, the least text teaches. If either label is missing everything scores next
to 0. Ties among neighbours go to the smaller id. Repeated rows repeat their scores; an empty table gives an empty result.
Extra columns pass through, but for those named like the added ones, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fold_key, read

TOXIC = 1_000
CLEAN = 3_000
NEIGHBOURS = 25
BLOCK = 64
#: Blocks that are scored in the first step; each further step takes four times as many.
FIRST_BLOCKS = 16
#: Terms in at least one of so many examples are kept as whole rows of weights, for the product with a batch of queries.
ROW_SHARE = 48
#: Queries of a batch.
BATCH = 64
#: Letters of a word's start that count as a term.
START = 4

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    counts = Counter(_WORD.findall(text.lower())) if text else Counter()
    starts: Counter = Counter()
    for w, n in counts.items():
        if len(w) > START:
            starts["^" + w[:START]] += n
    counts.update(starts)
    return counts


class Index:
    """Postings of the examples by term, cut at the borders of blocks of examples, and the greatest weight of each term in each block."""

    def __init__(self, bags: list[dict[str, int]], labels: list[int]):
        found = Counter(t for b in bags for t in b)
        kept = sorted(found, key=lambda t: (-found[t], t))
        self.number = {t: i for i, t in enumerate(kept)}
        self.idf = np.array([math.log((1 + len(bags)) / (1 + found[t])) for t in kept], np.float32)
        vectors = [self.vector(b) for b in bags]
        # examples that share their heaviest term stand together, which keeps the bounds of blocks low
        order = sorted(range(len(bags)), key=lambda j: (int(vectors[j][0][np.argmax(vectors[j][1])]) if len(vectors[j][0]) else -1, j))
        #: By place in the index: labels, and the place of the example in the order of ids, which breaks ties.
        self.labels = np.array([labels[j] for j in order], np.float64)
        self.turn = np.array(order, np.int64)
        place = np.argsort(order)
        self.n_blocks = -(-len(order) // BLOCK)
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
        example = np.repeat(place, [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0, np.float32)])
        by_term = np.lexsort((example, term))
        term, self.examples, self.weights = term[by_term], example[by_term].astype(np.int32), weight[by_term].astype(np.float32)
        #: starts[t] is where the postings of term t begin.
        self.starts = np.searchsorted(term, np.arange(len(kept) + 1)).astype(np.int64)
        #: Terms are numbered by falling frequency, so the first ones have rows.
        self.n_rows = sum(ROW_SHARE * found[t] >= len(bags) for t in kept)
        m = int(self.starts[self.n_rows])
        self.rows = np.zeros((self.n_rows, self.n_blocks * BLOCK), np.float32)
        self.rows[term[:m], self.examples[:m]] = self.weights[:m]
        #: Greatest weights of the rarer terms: the blocks where a term stands, by term.
        cell = term[m:] * self.n_blocks + self.examples[m:] // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.bound_block = (cell[first] % max(1, self.n_blocks)).astype(np.int32)
        self.bound = np.maximum.reduceat(self.weights[m:], first) if len(first) else np.zeros(0, np.float32)
        self.bound_starts = np.searchsorted(cell[first], np.arange(len(kept) + 1) * self.n_blocks).astype(np.int64)
        self.scored = self.blocks = 0
        self.curve = (0.0, -20.0)
        if len(set(labels)) == 2:
            self.curve = self._calibrated([vectors[j] for j in order])

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of unit length; repeated occurrences count by their logarithm."""
        return self._weighed({i: n for t, n in bag.items() if (i := self.number.get(t)) is not None})

    def _weighed(self, found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        i = np.fromiter(found, np.int64, len(found))
        w = (1 + np.log(np.fromiter(found.values(), np.float32, len(found)))) * self.idf[i]
        length = float(np.sqrt((w * w).sum()))
        return (i, w / length) if length > 0 else (i[:0], w[:0])

    def vector_of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """``vector`` of a text's terms, without a table of those that the index lacks."""
        found: dict[int, int] = {}
        starts: dict[str, int] = {}
        number = self.number.get
        for w, n in Counter(_WORD.findall(text.lower())).items() if text else ():
            if len(w) > START:
                s = w[:START]
                starts[s] = starts.get(s, 0) + n
            if (i := number(w)) is not None:
                found[i] = n
        for s, n in starts.items():
            if (i := number("^" + s)) is not None:
                found[i] = n
        return self._weighed(found)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], leave: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query vector the places of its nearest examples and their cosines, exactly; ``leave`` names an example of each query to leave out."""
        common = np.zeros((len(queries), self.n_rows), np.float32)
        for line, (i, w) in zip(common, queries, strict=True):
            line[i[i < self.n_rows]] = w[i < self.n_rows]
        known = common @ self.rows
        return [self._nearest(i[i >= self.n_rows], w[i >= self.n_rows], line, -1 if leave is None else leave[q]) for q, ((i, w), line) in enumerate(zip(queries, known, strict=True))]

    @staticmethod
    def _cells(i: np.ndarray, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of some terms in a table cut by ``starts``, and the query's weight at each."""
        length = starts[i + 1] - starts[i]
        first = np.cumsum(length) - length
        return np.repeat(starts[i] - first, length) + np.arange(length.sum()), np.repeat(w, length)

    def _nearest(self, i: np.ndarray, w: np.ndarray, known: np.ndarray, leave: int) -> tuple[np.ndarray, np.ndarray]:
        if leave >= 0:
            known[leave] = -1
        at, by = self._cells(i, w, self.bound_starts)
        m = self.bound_starts[self.n_rows]
        bound = known.reshape(-1, BLOCK).max(1) + np.bincount(self.bound_block[at - m if m else at], self.bound[at - m if m else at] * by, self.n_blocks)
        at, by = self._cells(i, w, self.starts)
        entries, gains = self.examples[at], self.weights[at] * by
        block_of = entries // BLOCK
        order = np.argsort(-bound, kind="stable")
        n = len(self.labels)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, FIRST_BLOCKS
        # what a neighbour has from common terms alone is a lower end of its score
        least = float(np.partition(known[:n], n - NEIGHBOURS)[n - NEIGHBOURS]) if n > NEIGHBOURS else 0.0
        while done < len(order):
            ahead = order[done : done + step]
            ahead = ahead[(bound[ahead] >= least - 1e-5) & (bound[ahead] > 0)]
            if not len(ahead):
                break
            chosen = np.zeros(self.n_blocks, bool)
            chosen[ahead] = True
            self.scored += len(ahead)
            here = chosen[block_of]
            s = (known + np.bincount(entries[here], gains[here], len(known))).reshape(-1, BLOCK)[ahead].ravel()
            j = (ahead[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            fine = (s > 1e-7) & (s >= least - 1e-5)
            places, scores = np.concatenate([places, j[fine]]), np.concatenate([scores, s[fine]])
            keep = np.lexsort((self.turn[places], -scores.astype(np.float32)))[:NEIGHBOURS]
            places, scores = places[keep], scores[keep]
            if len(scores) == NEIGHBOURS:
                least = max(least, float(scores[-1]))
            done, step = done + step, step * 4
        self.blocks += self.n_blocks
        return places, scores

    def vote(self, j: np.ndarray, s: np.ndarray) -> float:
        return float((s * self.labels[j]).sum() / s.sum()) if len(j) else 0.0

    def _calibrated(self, vectors: list) -> tuple[float, float]:
        """Slope and offset of the logistic curve with the best likelihood on left-out votes."""
        x = np.concatenate([[self.vote(j, s) for j, s in self.nearest(vectors[a : a + BATCH], list(range(a, min(a + BATCH, len(vectors)))))] for a in range(0, len(vectors), BATCH)])
        y, a, b = self.labels, 1.0, 0.0
        weight = np.where(y == 1, ((y == 0).sum() / (y == 1).sum()) ** 0.5, 1.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * x + b)))
            off = (p - y) * weight
            g = np.array([(off * x).sum() + 1e-2 * a, off.sum()])
            v = p * (1 - p) * weight
            h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
            da, db = np.linalg.solve(h, g)
            a, b = a - da, b - db
            if abs(da) + abs(db) < 1e-9:
                break
        return float(a), float(b)

    def score(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each text its probability, and the neighbours with their cosines."""
        a, b = self.curve
        out = []
        for first in range(0, len(texts), BATCH):
            for j, s in self.nearest([self.vector_of(t) for t in texts[first : first + BATCH]]):
                out.append((1 / (1 + math.exp(-max(-500.0, min(500.0, a * self.vote(j, s) + b)))), j, s))
        return out


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """The bounded sample: (doc_id, text, toxic) of labelled documents outside the held-out fold."""
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_key("doc_id") % folds != fold)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    # the least hashes of each label, limited in every task before the exchange
    few = [told.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    told = few[0].unionByName(few[1])
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(told), "doc_id")  # at most TOXIC + CLEAN rows
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def example_bags(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms, counts) of the examples' whole texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [terms(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "terms", "counts"])

    return rows.mapInArrow(run, "doc_id long, toxic int, terms array<string>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    rows = sorted(((r.doc_id, r.toxic, dict(zip(r.terms, r.counts, strict=True))) for r in example_bags(training_rows(docs, labels)).toLocalIterator()), key=lambda r: r[:2])
    return Index([b for _, _, b in rows], [y for _, y, _ in rows])


def score(df: DataFrame, index: Index, text: str = "text", evidence: bool = False) -> DataFrame:
    """Add ``score``, and with ``evidence`` also ``neighbours``: (label, cosine) of the nearest examples, nearest first; columns so named are replaced."""
    df = df.drop("score", "neighbours")
    shared = df.sparkSession.sparkContext.broadcast(index)  # the terms of at most TOXIC + CLEAN texts
    fields = [T.StructField("score", T.DoubleType())]
    kind = pa.list_(pa.struct([("label", pa.int32()), ("cosine", pa.float64())]))
    if evidence:
        fields.append(T.StructField("neighbours", T.ArrayType(T.StructType([T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(text).to_pylist())
            columns = [pa.array([p for p, _, _ in found], pa.float64())]
            if evidence:
                columns.append(pa.array([[{"label": int(shared.value.labels[a]), "cosine": float(c)} for a, c in zip(j, s, strict=True)] for _, j, s in found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    judged = score(docs, fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return judged.select("doc_id", F.coalesce(fold_key("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
