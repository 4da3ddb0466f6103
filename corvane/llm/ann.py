"""Approximate nearest neighbours by inner product: probed lists, scanned with adaptive dimensions.

Vectors get one more dimension, which makes all norms equal, so that the largest inner product is the least distance.
Centroids are fitted on a bounded sample; every vector goes to the list of its nearest centroid, and a query probes the
nearest lists. Within a list, vectors are rotated by a random orthogonal matrix and scanned in blocks of columns: after
each block the distance is estimated from the part seen so far, and a candidate is abandoned as soon as a hypothesis
test says that it won't come below the distance of the current 20th neighbour. Survivors are scored on the original
vectors in double precision.

A list is cut into parts of about ``PART_ROWS`` vectors and its queries into parts of about ``PART_QUERIES``, by hashes of
their ids, so that no task holds a large list; each pair of parts is scanned alone and the best of all parts are merged.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id, nor vectors of another length than the most frequent one (the smallest among equals). Rows that share an id count
once per vector; as a query, an id stands for its least vector. Ties go to the smaller id. If a query's probed lists hold
fewer than ``k`` candidates it probes on. Extra columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, read

K = 20
#: Rows of the sample that centroids are fitted on.
SAMPLE = 20_000
MOST_LISTS = 1_024
#: Share of the lists that a query probes. The vectors at hand are spread almost evenly over the
#: sphere, where lists say little: 0.25 finds 67 % of the true neighbours of 10,000, 0.7 finds 96 %. Clustered vectors need less.
PROBE_SHARE = 0.8
#: Lists of a small table, if it has rows for so many.
LEAST_LISTS = 20
COLUMNS = 32
#: Width of the hypothesis test: a larger value abandons later.
EPSILON = 2.1
PART_ROWS = 8_192
PART_QUERIES = 2_048
ROUNDS = 12


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common.d if common else -1))


class Lists:
    """Centroids of the lists, the rotation, and the norm that all vectors are lifted to."""

    def __init__(self, sample: np.ndarray, rows: int, norm: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.norm = norm * (1 + 1e-9)
        sample = np.unique(self.lift(sample), axis=0) if len(sample) else np.zeros((0, 1))
        n = int(min(MOST_LISTS, max(1, len(sample) // 8), max(LEAST_LISTS, round(rows**0.5 / 8))))
        width = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        centroids = sample[rng.choice(len(sample), n, replace=False)] if len(sample) else np.zeros((1, width))
        for _ in range(ROUNDS if len(sample) else 0):
            near = self._nearest(sample, centroids)
            counts = np.bincount(near, minlength=n)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, sample)
            centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        self.centroids = centroids
        self.probes = max(1, round(n * PROBE_SHARE))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    @staticmethod
    def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        half = (centroids * centroids).sum(1) / 2
        return np.concatenate([(half - x[i : i + 4096] @ centroids.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.lift(x), self.centroids)

    def probed(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists of each query, nearest first: ``probes`` of them, and on while they hold no more than k rows."""
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        order = np.argsort((self.centroids * self.centroids).sum(1) / 2 - lifted @ self.centroids.T, axis=1, kind="stable")
        out = []
        for line in order:
            enough = int(np.searchsorted(np.cumsum(sizes[line]), k + 1)) + 1
            out.append(line[: max(self.probes, enough)])
        return out


def scan(ids: np.ndarray, x: np.ndarray, rotated: np.ndarray, query_id: int, q: np.ndarray, q_rotated: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a part for a query, by inner product; ``bound`` is the sum of squared norms of query and lifted rows."""
    best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
    width, at, step = rotated.shape[1], 0, 256
    while at < len(ids):
        end = min(at + step, len(ids))
        alive: np.ndarray | slice = slice(at, end)
        if len(best_s) == k:
            limit = bound - 2 * best_s[-1]
            seen = np.zeros(end - at, np.float32)
            for c in range(0, width, COLUMNS):
                d = min(c + COLUMNS, width)
                part = rotated[alive, c:d] - q_rotated[c:d]
                seen += np.einsum("ij,ij->i", part, part)
                slack = (1 + EPSILON / d**0.5) ** 2 if d < width else 1 + 1e-5
                keep = np.flatnonzero(seen <= limit * (d / width) * slack + 1e-6)
                alive, seen = keep + at if isinstance(alive, slice) else alive[keep], seen[keep]
                if not len(alive):
                    break
        at, step = end, step * 2
        alive = np.arange(alive.start, alive.stop) if isinstance(alive, slice) else alive
        alive = alive[ids[alive] != query_id]
        if len(alive):
            s, i = np.concatenate([best_s, (x[alive] * q).sum(1)]), np.concatenate([best_i, ids[alive]])
            order = np.lexsort((i, -s))[:k]
            best_s, best_i = s[order], i[order]
    return best_i, best_s


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))


def search(df: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """For each query (vec_id divisible by ``every``), its k nearest rows: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.cut(valid(df))
    norms = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    sample = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    width = norms.d or 1
    lists = Lists(np.array(sample, np.float64).reshape(-1, width), norms.n, (norms.m or 0.0) ** 0.5)
    shared = spark.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids and a square matrix of the dimensions

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = shared.value.assign(_matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, pa.int32())], names=["vec_id", "v", "list"])

    placed = scratch.cut(rows.mapInArrow(assign, "vec_id long, v array<double>, list int"))
    sizes = np.zeros(len(lists.centroids), np.int64)
    for r in placed.groupBy("list").count().toLocalIterator():
        sizes[r.list] = r["count"]

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.probed(_matrix(b.column("v"), width), sizes, k)
            at = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(np.concatenate(found), pa.int32())], names=["query_id", "q", "list"])

    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    probes = scratch.cut(queries.mapInArrow(probe, "query_id long, q array<double>, list int"))
    parts = probes.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("q_parts"))
    parts = parts.join(placed.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("x_parts")), "list")
    parts = F.broadcast(scratch.cut(parts))  # at most MOST_LISTS rows
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = placed.join(parts, "list").withColumn("xp", F.pmod(F.xxhash64("vec_id"), F.col("x_parts")).cast("int")).select("list", "xp", spread("q_parts").alias("qp"), "vec_id", "v")
    q = probes.join(parts, "list").withColumn("qp", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int")).select("list", spread("x_parts").alias("xp"), "qp", "query_id", "q")

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if left.num_rows and right.num_rows:
            model = shared.value
            rows_ = np.unique(np.hstack([np.asarray(left.column("vec_id").combine_chunks(), np.int64).view(np.float64)[:, None], _matrix(left.column("v"), width)]).view(np.int64), axis=0)
            ids, v = rows_[:, 0].copy(), np.ascontiguousarray(rows_[:, 1:]).view(np.float64)
            rotated = (model.lift(v) @ model.rotation).astype(np.float32)
            for query_id, vector in zip(right.column("query_id").to_pylist(), _matrix(right.column("q"), width), strict=True):
                lifted = np.append(vector, 0.0)
                found, scores = scan(ids, v, rotated, query_id, vector, (lifted @ model.rotation).astype(np.float32), float(vector @ vector) + model.norm**2, k)
                out_q.append(np.full(len(found), query_id))
                out_i.append(found)
                out_s.append(scores)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
        return pa.table({"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_i, pa.int64()), "score": cat(out_s, pa.float64())})

    keys = ["list", "xp", "qp"]
    found = x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(part, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_adaptive_scan_ann(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op4_adaptive_scan_ann": op4_adaptive_scan_ann}
SQL: dict[str, str] = {}
