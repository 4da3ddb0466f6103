"""What callers plug in: rerankers, query decomposers, entailment models, and strategies of vector search.

A plug-in is a plain function over lists; it runs in batches beside the data. Where one fails, its rows are tried one by one, and
rows that still fail have no value, so that a search degrades instead of ending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import dense
from corvane.runtime import importable

#: Rows that a plug-in sees at once.
BATCH = 256


def _apply(df: DataFrame, f: Callable[..., list], columns: tuple[str, ...], name: str, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """Add ``name``: what ``f`` makes of lists of the columns' values."""
    importable(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                values = [batch.column(c).to_pylist() for c in columns]
                try:
                    out = list(f(*values))
                except Exception:  # noqa: BLE001  whatever a plug-in raises
                    out = []
                    for row in zip(*values, strict=True):
                        try:
                            out += f(*([v] for v in row))
                        except Exception:  # noqa: BLE001
                            out.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def rerank(hits: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], first: int = 8) -> DataFrame:
    """Rescore the first hits (query_id, query, id, rank, text) of each query: query_id, id, rerank_score, rank, degraded.

    The tail keeps its order. A query with a hit that the scorer can't score keeps its whole order and is marked.
    """
    block = F.col("rank") <= first
    scored = _apply(hits.filter(block), scorer, ("query", "text"), "rerank_score", T.DoubleType(), pa.float64()).select("query_id", "id", "rerank_score")
    whole = Window.partitionBy("query_id")
    marked = hits.select("query_id", "id", "rank", block.alias("block")).join(scored, ["query_id", "id"], "left").withColumn("degraded", F.max(F.col("block") & F.col("rerank_score").isNull()).over(whole))
    order = whole.orderBy(F.desc("block"), F.when(F.col("block") & ~F.col("degraded"), -F.round("rerank_score", 6)).otherwise(0.0), "rank")
    return marked.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), F.row_number().over(order).alias("rank"), "degraded")


def decompose(queries: DataFrame, decomposer: Callable[[list[str]], list[list[str]]], text: str = "text") -> DataFrame:
    """One row for each part (from 0) of a query that the decomposer names; a query that it fails on is its own only part."""
    parts = _apply(queries, decomposer, (text,), "parts", T.ArrayType(T.StringType()), pa.list_(pa.string()))
    return parts.withColumn("parts", F.coalesce("parts", F.array(text))).select(*queries.columns, F.posexplode("parts").alias("part", "subquery"))


def entail(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]], threshold: float = 0.5) -> DataFrame:
    """Add ``entailment`` and ``entailed`` to pairs (premise, hypothesis); what the model fails on is not entailed."""
    scored = _apply(pairs, model, ("premise", "hypothesis"), "entailment", T.DoubleType(), pa.float64())
    return scored.withColumn("entailed", F.coalesce(F.col("entailment") >= threshold, F.lit(False)))


#: Strategies of vector search, by name: queries (query_id, q), vectors (id, v) and k give query_id, id, score, rank.
STRATEGIES: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "exact": dense.knn,
    "quantised": lambda queries, vectors, k: dense.knn(queries, dense.quantised(vectors), k),
    "sketched": dense.sketched_knn,
}


def search(queries: DataFrame, vectors: DataFrame, k: int, strategy: str = "exact") -> DataFrame:
    return STRATEGIES[strategy](queries, vectors, k)
