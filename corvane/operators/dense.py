"""Vector scans: exact nearest neighbours by squared distance, and the offline embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.lexical import top
from corvane.runtime import importable

DIGITS = 6
#: Numbers in a block of queries that is broadcast (8 bytes each); larger batches are searched block by block.
QUERY_NUMBERS = 4_000_000
#: Distances that a task computes at once, and numbers of the vectors it measures again at once.
CELLS = 1_000_000
#: Rows that a task gives on at once.
GIVEN = 65_536
#: Tokens whose place a worker remembers.
KNOWN_TOKENS = 200_000

_TOKEN = re.compile("[A-Za-z0-9_]+")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def knn(queries: DataFrame, vectors: DataFrame, k: int, same: bool = True) -> DataFrame:
    """The k nearest rows of ``vectors`` (id, v) for each of ``queries`` (query_id, q): query_id, id, score, rank; a row is no neighbour of its own id.

    With ``same`` off, ids of queries and rows name different things, and equal ids are neighbours like others. Where both have
    a column ``scope``, a query meets the rows of its own scope alone.

    Queries go to the vectors: each block of them is a broadcast of checked size, tasks keep their own k best, and only
    those are exchanged. Scores are squared distances, rounded; ties go to the smaller id.
    """
    importable(vectors.sparkSession)
    scoped = "scope" in queries.columns and "scope" in vectors.columns
    scope = F.col("scope").cast("string") if scoped else F.lit("")
    vectors = vectors.select("id", "v", scope.alias("scope")).filter("scope is not null")
    found = None
    for ids, q, scopes in _query_blocks(queries.select("query_id", F.col("q").cast("array<double>").alias("q"), scope.alias("scope")), k):
        part = _block(vectors, ids, q, scopes if scoped else None, k, same)
        found = part if found is None else found.unionByName(part)
    return top(found, k, descending=False)


def _query_blocks(queries: DataFrame, k: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and scopes of queries, in blocks of ``QUERY_NUMBERS`` numbers, and as many neighbours, at most; an empty one if there are no queries."""
    held: list = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(held[0].q) if held else 1
        return np.array([r.query_id for r in held], np.int64), np.array([r.q for r in held], np.float64).reshape(-1, width), np.array([r.scope for r in held], object)

    some = False
    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) * max(len(r.q), k) >= QUERY_NUMBERS:
            yield block()
            held, some = [], True
    if held or not some:
        yield block()


def _block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, scopes: np.ndarray | None, k: int, same: bool) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q, scopes))

    def measured(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rounded distances of pairs of rows, a part at a time."""
        step = max(1, CELLS // max(1, x.shape[1]))
        return np.concatenate([np.round(((x[i[a : a + step]] - q[j[a : a + step]]) ** 2).sum(1), DIGITS) for a in range(0, len(i), step)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, scopes = shared.value
        if not len(ids):
            return
        norms = (q * q).sum(1)
        # a query's best so far, in order; places that no row has taken are infinitely far
        found, scores = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), np.inf)
        for batch in batches:
            every = np.asarray(batch.column("id"))
            vectors = np.asarray(batch.column("v").flatten(), np.float64).reshape(len(every), -1)
            for at in range(0, len(every), 4_096):
                own, x = every[at : at + 4_096], vectors[at : at + 4_096]
                square, step = (x * x).sum(1), max(1, CELLS // len(own))
                within = np.array(batch.column("scope").slice(at, 4_096).to_pylist(), object) if scopes is not None else None
                for low in range(0, len(ids), step):
                    some = slice(low, low + step)
                    # one product gives all distances but for the last digits; what may be among the nearest is measured again
                    near = norms[some, None] + square - 2 * q[some] @ x.T
                    if within is not None:
                        near[scopes[some, None] != within] = np.inf
                    if same:
                        near[ids[some, None] == own] = np.inf
                    most = np.partition(near, k, axis=1)[:, k] if len(own) > k else np.inf
                    j, i = np.nonzero((near <= np.minimum(scores[some, -1], most)[:, None] + 1e-5) & (near < np.inf))
                    if not len(j):
                        continue
                    met, turn = np.unique(j, return_inverse=True)
                    met += low
                    line = np.concatenate([np.repeat(np.arange(len(met)), k), turn])
                    all_found = np.concatenate([found[met].ravel(), own[i]])
                    all_scores = np.concatenate([scores[met].ravel(), measured(x, q, i, j + low)])
                    order = np.lexsort((all_found, all_scores, line))
                    line = line[order]
                    order = order[np.arange(len(line)) - np.searchsorted(line, line) < k]
                    found[met], scores[met] = all_found[order].reshape(-1, k), all_scores[order].reshape(-1, k)
        step = max(1, GIVEN // k)
        for low in range(0, len(ids), step):
            j, i = np.nonzero(scores[low : low + step] < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[low + j], pa.int64()), pa.array(found[low + j, i], pa.int64()), pa.array(scores[low + j, i], pa.float64())], names=["query_id", "id", "score"])

    return vectors.select("id", F.col("v").cast("array<double>").alias("v"), "scope").filter("v is not null").mapInArrow(run, "query_id long, id long, score double")


def quantised(vectors: DataFrame) -> DataFrame:
    """(id, v) with each dimension rounded to 256 steps between its least and greatest value."""
    ends = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    ends = ends.agg(F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))).alias("ends"))  # one row, as wide as a vector
    step = lambda x, e: F.when(e["hi"] > e["lo"], e["lo"] + F.round((x - e["lo"]) / (e["hi"] - e["lo"]) * 255) * (e["hi"] - e["lo"]) / 255).otherwise(e["lo"])
    return vectors.crossJoin(F.broadcast(ends)).select("id", F.zip_with(F.col("v").cast("array<double>"), "ends", step).alias("v"))


def hash_embedding(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Add ``embedding``: counts of tokens by FNV-1a hash, of unit length, rounded. The embedder that needs no provider."""
    importable(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}

        def placed(token: str) -> int:
            h = 0x811C9DC5
            for b in token.encode():
                h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
            if len(place) >= KNOWN_TOKENS:
                place.clear()
            place[token] = h % dim
            return h % dim

        for batch in batches:
            vectors = np.zeros((batch.num_rows, dim))
            for line, t in zip(vectors, batch.column(text), strict=True):
                found = [place[w] if w in place else placed(w) for w in _TOKEN.findall((t.as_py() or "").lower())]
                line += np.bincount(found, minlength=dim) if found else 0
            norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
            out = np.round(vectors / np.where(norm > 0, norm, 1), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * dim, out.ravel())], names=[*batch.schema.names, "embedding"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


#: Bits of a sketch, the share of the rows that are measured, and how many times k at least.
BITS, SHARE, LEAST = 512, 0.08, 4


def directions(bits: int, width: int) -> np.ndarray:
    """Directions of random signs, the same wherever they are computed."""
    return np.array([[1 if hashlib.md5(f"{b}:{i}".encode()).hexdigest()[0] < "8" else -1 for i in range(width)] for b in range(bits)], np.float64).reshape(bits, width)  # noqa: S324


def _sketches(x: np.ndarray, towards: np.ndarray) -> np.ndarray:
    return np.packbits(x @ towards.T >= 0, axis=1).view(np.uint64)


def sketched_knn(queries: DataFrame, vectors: DataFrame, k: int, bits: int = BITS, share: float = SHARE) -> DataFrame:
    """``knn`` among the rows whose sketches (the sides of random directions on which they lie) differ least from the query's: approximate.

    A first pass counts for each query how many rows differ by how many bits; the second measures the rows up to the number of bits
    within which ``share`` of all rows lie, where they are. No pairs are exchanged, and results don't depend on partitions.
    """
    importable(vectors.sparkSession)
    spark, rows, found = vectors.sparkSession, vectors.select("id", F.col("v").cast("array<double>").alias("v")).filter("v is not null"), None
    wanted = max(int(np.ceil(rows.count() * share)), LEAST * k)
    for ids, q, _ in _query_blocks(queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.lit("").alias("scope"))):
        part = _sketch_block(spark, rows, ids, q, k, bits, wanted)
        found = part if found is None else found.unionByName(part)
    return top(found, k, descending=False)


def _sketch_block(spark, rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, bits: int, wanted: int) -> DataFrame:  # noqa: ANN001
    towards = directions(bits, q.shape[1])
    shared = spark.sparkContext.broadcast((ids, q, towards, _sketches(q, towards)))  # a block of queries

    def batches_of(batches: Iterable[pa.RecordBatch]):  # noqa: ANN202
        """Ids and vectors of slices of rows, and how many bits each query's sketch differs by from theirs."""
        ids, q, towards, own = shared.value
        step = max(1, min(4_096, QUERY_NUMBERS // max(1, len(ids))))
        for batch in batches:
            every = np.asarray(batch.column("id"))
            vectors = np.asarray(batch.column("v").flatten(), np.float64).reshape(len(every), -1)
            for at in range(0, len(every), step):
                x = vectors[at : at + step]
                sketch = _sketches(x, towards)
                yield every[at : at + step], x, sum(np.bitwise_count(own[:, None, w] ^ sketch[None, :, w]).astype(np.int32) for w in range(own.shape[1]))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value[0])
        sums = np.zeros((n, bits + 1), np.int64)
        for every, _, apart in batches_of(batches) if n else ():
            apart = np.where(shared.value[0][:, None] == every, bits, apart)
            sums += np.bincount((np.arange(n)[:, None] * (bits + 1) + apart).ravel(), minlength=sums.size).reshape(sums.shape)
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums[at], pa.int64())], names=["q", "apart", "n"])

    sums = rows.mapInArrow(count, "q int, apart int, n long").groupBy("q", "apart").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("q").orderBy("apart").rowsBetween(Window.unboundedPreceding, -1))
    limits = np.full(len(ids), -1)
    for r in sums.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < wanted).groupBy("q").agg(F.max("apart").alias("apart")).collect():  # a number for each query of the block
        limits[r.q] = r.apart
    limits_shared = spark.sparkContext.broadcast(limits)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, *_ = shared.value
        line, found, scores = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for every, x, apart in batches_of(batches) if len(ids) else ():
            j, i = np.nonzero((apart <= limits_shared.value[:, None]) & (ids[:, None] != every))
            d = x[i] - q[j]
            line, found, scores = np.concatenate([line, j]), np.concatenate([found, every[i]]), np.concatenate([scores, np.round((d * d).sum(1), DIGITS)])
            order = np.lexsort((found, scores, line))
            line, found, scores = line[order], found[order], scores[order]
            turn = np.arange(len(line)) - np.searchsorted(line, line)
            line, found, scores = (z[turn < k] for z in (line, found, scores))
        yield pa.RecordBatch.from_arrays([pa.array(ids[line], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    return rows.mapInArrow(measure, "query_id long, id long, score double")
