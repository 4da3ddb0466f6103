"""Near duplicates among vectors of equal label, by product quantisation.

Vectors are scaled to unit norm; equal ones of a label are one class from then on. A class belongs to the coarse list of its
nearest centroid, and what is left of it is coded by one of some codewords in each of several subspaces (centroids
and codewords are fitted on a bounded sample, every class is coded). Classes are stored by (label, list) in blocks. A block meets another of its label
where a member of the one probes a list that the other holds. There a table of the inner products of each vector's parts
with all codewords gives the distance to a coded vector as a sum of looked-up numbers, and what passes is compared anew by exact cosine.

Neither step loses a link. A vector at most ``r`` away lies in a list's cell only if the cell's border with one's own is at most
``r`` away, so exactly such lists are probed. And what is at most ``r`` away is at most ``r`` plus the stored coding error away from its code.

A pair of blocks gives on how many links each class has, and a forest that spans what is linked, never all pairs.

Defined results: vectors that are null, zero or hold null or non-finite components, of another length than the most frequent
one (the smallest among equals), or without a label link with nothing. Rows are vectors of their own, also
where they repeat an id or a whole row; those without an id link as others do, but give no component its id. Ties need no rule. Extra
columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.blocks import centroids_of, in_blocks, matrix, most_frequent_length, nearest, sample_of, usable, vectors
from corvane.llm.common import Scratch, read
from corvane.llm.components import connected_components

COSINE = 0.93
#: Subspaces, and codewords of each.
PARTS, CODES = 8, 256
#: Lists are fitted on a sample, so their number is bounded; blocks and not lists bound a task.
MOST_LISTS = 1_024
BLOCK = 2_048
#: Pairs of vectors that are looked at in memory at once.
PAIRS = 262_144
SLACK = 1e-6


class Quantiser:
    """Coarse centroids, codewords of what they leave, and the radius of a link."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float):
        self.radius = (2 - 2 * cosine) ** 0.5 + SLACK
        width = sample.shape[1]
        self.lists = centroids_of(sample, int(min(MOST_LISTS, max(1, len(sample) // 16), max(1, round(rows**0.5 / 4)))))
        self.cuts = np.array_split(np.arange(width), min(PARTS, width))
        left = sample - self.lists[nearest(sample, self.lists)]
        self.words = [centroids_of(left[:, c], CODES, 6) for c in self.cuts]
        self.apart = np.sqrt(np.maximum(0.0, (self.lists**2).sum(1)[:, None] + (self.lists**2).sum(1) - 2 * self.lists @ self.lists.T))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the coding error of unit vectors."""
        near = nearest(x, self.lists)
        left = x - self.lists[near]
        codes = np.stack([nearest(left[:, c], w) for c, w in zip(self.cuts, self.words, strict=True)], 1)
        for j, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            left[:, c] -= w[codes[:, j]]
        return near, codes.astype(np.uint8), np.sqrt((left**2).sum(1))

    def decoded(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.lists[near].copy()
        for j, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            out[:, c] += w[codes[:, j]]
        return out

    def probed(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Which lists can hold what is within the radius of each vector: those whose border with its own list is as near."""
        square = (self.lists**2).sum(1) - 2 * x @ self.lists.T
        beyond = square - np.take_along_axis(square, near[:, None], 1)
        return beyond <= 2 * self.radius * self.apart[near] + SLACK

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each subspace, the inner products of vectors with all codewords."""
        return [x[:, c] @ w.T for c, w in zip(self.cuts, self.words, strict=True)]


def joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots of members after links between ``a`` and ``b``; a root is the least member of what is linked."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return roots
        a, b = a[apart], b[apart]
        np.minimum.at(roots, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (further := roots[roots] != roots).any():
            roots = np.where(further, roots[roots], roots)


def links_between(model: Quantiser, x: np.ndarray, y: np.ndarray, near: tuple[np.ndarray, np.ndarray], codes: np.ndarray, error: np.ndarray, cosine: float, same: bool):  # noqa: ANN201
    """Pairs (i, j) of rows of ``x`` and ``y`` whose cosine reaches the threshold, chunk by chunk; each once if both are the ``same``.

    ``near`` has the lists of both, ``codes`` and ``error`` are those of ``y``.
    """
    probes, tables = model.probed(x, near[0]), model.tables(x)
    coarse = x @ model.lists.T
    decoded = model.decoded(near[1], codes)
    most = (1 + (decoded**2).sum(1) - (model.radius + error) ** 2) / 2 - SLACK  # of the inner product with the code
    for number in np.unique(near[1]):
        ys, xs = np.flatnonzero(near[1] == number), np.flatnonzero(probes[:, number])
        step = max(1, PAIRS // len(ys))
        for at in range(0, len(xs), step):
            own = xs[at : at + step]
            estimate = np.repeat(coarse[own, number][:, None], len(ys), 1)
            for j, table in enumerate(tables):
                estimate += table[own[:, None], codes[ys, j][None, :]]
            i, k = np.nonzero(estimate >= most[ys])
            i, k = own[i], ys[k]
            if same:
                i, k = i[i < k], k[i < k]
            for start in range(0, len(i), PAIRS // 4):
                a, b = i[start : start + PAIRS // 4], k[start : start + PAIRS // 4]
                linked = (x[a] * y[b]).sum(1) >= cosine
                yield a[linked], b[linked]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, initial=1e-300)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None] + 0.0


def classes_of(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """All rows (vec_id, label, v: null where it links with nothing), the classes of equal ones, and the length of vectors."""
    v = F.col("v")
    fine = usable(v) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    rows = df.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = scratch.cut(rows.withColumn("v", F.when(fine, F.transform(v, lambda x: x + F.lit(0.0)))))
    width = most_frequent_length(rows.filter(v.isNotNull()))
    rows = rows.withColumn("v", F.when(F.size("v") == (width or -1), F.col("v")))
    classes = rows.filter(v.isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    return rows, scratch.cut(classes.withColumn("node", F.monotonically_increasing_id())), width or 1


def dedup(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each of ``df`` (vec_id, label, embedding): n_links, component_id and whether it is the one of its component to keep."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows, classes, width = classes_of(df, scratch)
    total = classes.count()
    model = Quantiser(unit(sample_of(classes, "node", width)), total, cosine)
    shared = spark.sparkContext.broadcast(model)  # at most MOST_LISTS centroids and PARTS x CODES codewords

    def code(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = unit(matrix(b.column("v"), width))
            near, codes, error = shared.value.coded(x)
            probes = shared.value.probed(x, near)
            offsets = np.r_[0, np.cumsum(probes.sum(1))]
            reach = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.nonzero(probes)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("node"), b.column("copies"), vectors(x), pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), reach], names=["label", "node", "copies", "v", "list", "codes", "error", "probes"])

    coded = classes.select("label", "node", "copies", "v").mapInArrow(code, "label string, node long, copies long, v array<double>, list int, codes binary, error double, probes array<int>")
    coded = scratch.cut(in_blocks(scratch.cut(coded.withColumn("label_key", F.xxhash64("label"))), ["label_key", "label", "list", "node"], BLOCK, total, "label_key"))
    seeks = coded.select("block", "label", F.explode("probes").alias("list")).distinct()
    holds = coded.select(F.col("block").alias("other"), "label", "list").distinct()
    pairs = scratch.cut(seeks.join(holds, ["label", "list"]).select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).distinct())
    members = coded.drop("probes", "label_key")
    left = members.join(pairs.select(F.col("a").alias("block"), F.col("b").alias("other")), "block")
    right = members.join(pairs.filter(F.col("a") != F.col("b")).select(F.col("b").alias("block"), F.col("a").alias("other")), "block")
    right = right.toDF(*right.columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        same = not right.num_rows
        both = [t.combine_chunks() for t in ((left,) if same else (left, right))]
        nodes, copies = (np.concatenate([np.asarray(t.column(c)) for t in both]) if left.num_rows else np.zeros(0, np.int64) for c in ("node", "copies"))
        counts, roots = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        if left.num_rows:
            labels = [np.asarray(t.column("label").to_pylist(), object) for t in both]
            x, y = matrix(left.column("v"), width), matrix(both[-1].column("v"), width)
            codes = np.frombuffer(b"".join(both[-1].column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
            shift = 0 if same else len(x)
            lists = np.asarray(left.column("list")), np.asarray(both[-1].column("list"))
            for a, b in links_between(shared.value, x, y, lists, codes, np.asarray(both[-1].column("error")), cosine, same):
                equal = labels[0][a] == labels[-1][b]  # blocks hold one label but where two hash alike
                a, b = a[equal], b[equal] + shift
                counts += (np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))).astype(np.int64)
                roots = joined(roots, a, b)
        at = np.flatnonzero(counts)
        return pa.table({"node": pa.array(nodes[at]), "links": pa.array(counts[at]), "root": pa.array(nodes[roots[at]])})

    met = scratch.cut(left.groupBy("block", "other").cogroup(right.groupBy("other", "block")).applyInArrow(meet, "node long, links long, root long"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    told = classes.join(links, "node", "left").join(components, "node", "left").select("label", "v", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = told.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    told = scratch.cut(told.join(least, "component").select("label", "v", "n_links", "component_id"))
    linked = rows.filter(F.col("v").isNotNull()).join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_vector_dedup(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return dedup(read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(least(a, b)) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN components c ON c.a = vec_id LEFT JOIN counts k ON k.a = vec_id
"""

QUERIES = {"op13_vector_dedup": op13_vector_dedup}
SQL = {"op13_vector_dedup": _SQL}
