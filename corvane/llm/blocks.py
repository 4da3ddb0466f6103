"""Vectors in sorted blocks, for searches that meet blocks in matrix products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that centroids and codes are fitted on.
SAMPLE = 20_000


def usable(v: Column) -> Column:
    """Whether an array of doubles is a vector: not null nor empty, no component null or not finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def most_frequent_length(rows: DataFrame) -> int:
    """Length of most of the vectors ``v``, the smallest among equals; 0 if there are none."""
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first.d if first else 0


def sample_of(rows: DataFrame, key: str, width: int, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` vectors ``v``, by hash of their key: a sample of bounded size for fitting."""
    picked = rows.orderBy(F.xxhash64(key), key).limit(most).select("v").collect()
    return np.array([r.v for r in picked], np.float64).reshape(-1, width)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row, the first among equals."""
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centroids.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def centroids_of(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most ``n`` centroids by Lloyd's rounds; one at zero if there is no sample."""
    sample = np.unique(sample, axis=0)
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centroids)
        order = np.argsort(near, kind="stable")
        there, starts, counts = np.unique(near[order], return_index=True, return_counts=True)
        centroids[there] = np.add.reduceat(sample[order], starts, axis=0) / counts[:, None]
    return centroids


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of lists of doubles as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))


def vectors(x: np.ndarray) -> pa.Array:
    """A matrix as a column of lists of doubles."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def in_blocks(rows: DataFrame, keys: list[str], size: int, total: int, apart: str | None = None) -> DataFrame:
    """``rows`` sorted by ranges of ``keys``, with a column ``block``: at most ``size`` rows that follow each other, of one value of ``apart``.

    ``keys`` must tell rows apart well enough that ranges of them are balanced. Write the result before using it twice.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            kind = np.asarray(b.column(apart)) if apart else np.zeros(b.num_rows, np.int8)
            numbers = np.empty(b.num_rows, np.int64)
            starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if b.num_rows else []
            for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if last is not None and kind[start] != last and filled:
                    block, filled = block + 1, 0
                last = kind[start]
                at = filled + np.arange(end - start)
                numbers[start:end] = block + at // size
                block, filled = block + (filled + end - start) // size, (filled + end - start) % size
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *b.columns], names=["block", *b.schema.names])

    schema = "block long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartitionByRange(max(1, -(-total // size)), *keys).sortWithinPartitions(*keys).mapInArrow(cut, schema)
