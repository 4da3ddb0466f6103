"""Hard negatives by inner product, over one-dimensional distance keys.

Vectors get one more dimension, which makes all norms equal, so that a larger inner product is a smaller distance. Every
vector belongs to the nearest of some pivots (fitted on a bounded sample) and is stored in order of (pivot, distance to it),
in blocks. By the triangle inequality, what lies within a radius of an anchor has, at each pivot, its key in an interval around the anchor's
own distance. Anchors scan those intervals from the inside out: each round takes the next blocks, four times as many as before, and
stops where the least distance that the blocks left can have certifies that they hold nothing better than what is found.
Two searches follow each other: for an anchor's positives, then for each positive's negatives, which lie in an interval of scores.

Anchors are taken in groups of neighbours, and a block meets a group in one product of matrices, for all rows of the block; within it only
anchors whose own interval meets the block are looked at. A task holds one block and one group, both of bounded size, and
gives on each anchor's few best.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do vectors of another length
than the most frequent one (the smallest among equals), nor those with a component of ``MOST`` or more once scaled (their products would outgrow
a long). Rows that share an id count once per list, with their best score; as an anchor, an id stands for the least of its
(label, vector). Ties go to the smaller id. Anchors without positives, and positives without negatives, give no rows. Extra columns
don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.blocks import centroids_of, in_blocks, matrix, most_frequent_length, nearest, sample_of, usable
from corvane.llm.common import Scratch, read

#: Positives of an anchor, and negatives of a positive.
K = 5
#: Negatives have at least so many hundredths of the positive's score, and at most as much.
LEAST_SHARE = 80
#: Components are scaled by this before they are rounded down.
SCALE = 256
MOST = float(2**27)
MOST_PIVOTS = 64
BLOCK, GROUP = 1_024, 4_096
FIRST_BLOCKS, GROWTH = 4, 4


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows with whole components, exactly, as longs."""
    largest = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if largest * largest * max(1, x.shape[1]) < 2**53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows, ties to smaller ids, each id once."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k]
        top = np.flatnonzero(scores >= floor)
        if len(np.unique(ids[top])) < k:
            top = np.arange(len(scores))
    else:
        top = np.arange(len(scores))
    order = top[np.lexsort((ids[top], -scores[top]))]
    return order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]


class Keys:
    """Pivots, and the norm that all vectors are lifted to."""

    def __init__(self, sample: np.ndarray, rows: int, square: float):
        self.square = square * (1 + 1e-9) + 1e-9
        lifted = self.lift(sample)
        self.pivots = centroids_of(lifted, int(min(MOST_PIVOTS, max(1, round(rows**0.5 / 4)))))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.square - (x * x).sum(1)))[:, None]])

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lifted = self.lift(x)
        pivot = nearest(lifted, self.pivots)
        return pivot, np.sqrt(((lifted - self.pivots[pivot]) ** 2).sum(1))

    def distances(self, anchors: np.ndarray) -> np.ndarray:
        """From anchors, which have 0 in the added dimension, to all pivots."""
        flat = np.hstack([anchors, np.zeros((len(anchors), 1))])
        return np.sqrt(np.maximum(0.0, (flat * flat).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * flat @ self.pivots.T))

    def most(self, anchor_square: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The largest score at a distance or more; a little more, for rounding."""
        total = self.square + anchor_square
        return (total - distance**2) / 2 + 1e-9 * total + 1e-6


def rows_of(df: DataFrame, relabel: Column) -> DataFrame:
    """(vec_id, label, v) of what takes part, with whole components."""
    v = F.col("v")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))
    rows = df.select("vec_id", relabel.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), scaled.alias("w"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(v) & F.forall("w", lambda x: F.abs(x) < MOST))
    return rows.select("vec_id", "label", F.col("w").alias("v"))


def least_negative(positive: Column) -> Column:
    """The least score that a negative may have; more than the positive's own, so none, where that is below zero."""
    off = F.call_function("div", positive, F.lit(100)) * (100 - LEAST_SHARE) + F.call_function("div", positive % 100 * (100 - LEAST_SHARE), F.lit(100))
    return F.when(positive < 0, F.lit(0)).otherwise(positive - off).cast("long")


def _rounds(scratch: Scratch, placed: DataFrame, units: DataFrame, anchors: DataFrame, scan, schema: str, ids: list[str], states):  # noqa: ANN001
    """Scan blocks from the inside out until the bounds of all groups are certified; the best of each list, (``ids``, vec_id, score).

    ``states`` gives from what is found so far the anchors with their bounds, and the least bound of each group.
    """
    order = Window.partitionBy(*ids).orderBy(F.desc("score"), "vec_id")
    found, done, step = None, 0, FIRST_BLOCKS
    while True:
        state, floors = states(anchors, found)
        state = scratch.cut(state)
        left = units.filter(F.col("turn") > done).join(floors(state), "group").filter(F.col("most") >= F.col("floor"))
        todo = scratch.cut(left.filter(F.col("turn") <= done + step).select("block", "group"))
        if todo.isEmpty() and left.isEmpty():
            return found if found is not None else placed.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in [*ids, "vec_id", "score"]))
        new = placed.join(todo, "block").groupBy("block", "group").cogroup(state.join(todo, "group").groupBy("block", "group")).applyInArrow(scan, schema)
        new = new.unionByName(found) if found is not None else new
        new = new.groupBy(*ids, "vec_id").agg(F.max("score").alias("score"))
        merged = scratch.cut(new.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= K).drop("r"))
        scratch.drop(state, todo, *([found] if found is not None else []))
        found, done, step = merged, done + step, step * GROWTH


def mine(df: DataFrame, every: int = 100, relabel: Column | None = None) -> DataFrame:
    """Of each anchor (vec_id divisible by ``every``) and each of its positives, the hard negatives: anchor_id, positive_id, rank, negative_id and both scores."""
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.cut(rows_of(df, F.col("label") if relabel is None else relabel))
    width = most_frequent_length(rows) or 1
    rows = rows.filter(F.size("v") == width)
    sums = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    keys = Keys(sample_of(rows, "vec_id", width), sums.n, sums.m or 0.0)
    shared = spark.sparkContext.broadcast(keys)  # at most MOST_PIVOTS vectors

    def place(batches):  # noqa: ANN001, ANN202
        for b in batches:
            pivot, distance = shared.value.key(matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot, pa.int32()), pa.array(distance)], names=[*b.schema.names, "pivot", "distance"])

    keyed = scratch.cut(rows.mapInArrow(place, "vec_id long, label long, v array<double>, pivot int, distance double"))
    by = ["pivot", "distance", "vec_id"]
    placed = scratch.cut(in_blocks(keyed, by, BLOCK, sums.n, "pivot"))
    blocks = placed.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    least = keyed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "pivot", "distance")).alias("row")).select("vec_id", "row.*")
    least = scratch.cut(least)
    anchors = in_blocks(least, by, GROUP, least.count())
    anchors = scratch.cut(anchors.select(F.col("block").alias("group"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor")))
    scratch.drop(keyed, least)

    def reach(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = matrix(b.column("anchor"), width)
            d, n = shared.value.distances(x), len(shared.value.pivots)
            at = pa.array(np.repeat(np.arange(len(x)), n))
            yield pa.RecordBatch.from_arrays([b.column("group").take(at), pa.array(np.tile(np.arange(n), len(x)), pa.int32()), pa.array(d.ravel()), pa.array(np.repeat((x * x).sum(1), n))], names=["group", "pivot", "d", "square"])

    reaches = anchors.mapInArrow(reach, "group long, pivot int, d double, square double").groupBy("group", "pivot").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("square").alias("square"))
    gap = F.greatest(F.lit(0.0), F.col("d0") - F.col("high"), F.col("low") - F.col("d1"))
    total = F.lit(keys.square) + F.col("square")
    units = reaches.join(blocks, "pivot").select("group", "block", gap.alias("gap"), ((total - gap * gap) / 2 + total * 1e-9 + 1e-6).alias("most"))
    units = scratch.cut(units.withColumn("turn", F.row_number().over(Window.partitionBy("group").orderBy("gap", "block"))).drop("gap"))

    def met(left: pa.Table, right: pa.Table, floors: np.ndarray):  # noqa: ANN202
        """Ids, labels and scores of a block, and the anchors whose interval meets it."""
        model, ids, labels = shared.value, np.asarray(left.column("vec_id")), np.asarray(left.column("label"))
        x, a = matrix(left.column("v"), width), matrix(right.column("anchor"), width)
        keys_ = np.asarray(left.column("distance"))
        d = model.distances(a)[:, left.column("pivot")[0].as_py()]
        gap_ = np.maximum(0.0, np.maximum(d - keys_.max(), keys_.min() - d))
        alive = np.flatnonzero(model.most((a * a).sum(1), gap_) >= floors)
        return ids, labels, product(x, a[alive]), alive

    def scan_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            floors = np.asarray(right.column("bound").to_numpy(), np.float64)
            ids, labels, scores, alive = met(left, right, floors)
            for column, i in enumerate(alive):
                anchor, label = right.column("anchor_id")[i].as_py(), right.column("anchor_label")[i].as_py()
                at = np.flatnonzero((labels == label) & (ids != anchor) & (scores[:, column] >= floors[i]))
                at = at[best(scores[at, column], ids[at], K)]
                out += [(anchor, int(ids[j]), int(scores[j, column])) for j in at]
        return pa.table(dict(zip(("anchor_id", "vec_id", "score"), ([r[c] for r in out] for c in range(3)), strict=True)), schema=pa.schema([(c, pa.int64()) for c in ("anchor_id", "vec_id", "score")]))

    def scan_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            bounds = right.column("bounds").to_pylist()
            ids, labels, scores, alive = met(left, right, np.array([min(b) for b in bounds], np.float64))
            for column, i in enumerate(alive):
                anchor, label = right.column("anchor_id")[i].as_py(), right.column("anchor_label")[i].as_py()
                mine_ = np.flatnonzero((labels != label) & (ids != anchor) & (scores[:, column] >= min(bounds[i])))
                for positive, above, floor in zip(right.column("positives")[i].as_py(), right.column("above")[i].as_py(), bounds[i], strict=True):
                    at = mine_[(scores[mine_, column] <= above) & (scores[mine_, column] >= floor)]
                    at = at[best(scores[at, column], ids[at], K)]
                    out += [(anchor, positive, int(ids[j]), int(scores[j, column])) for j in at]
        names = ("anchor_id", "positive_id", "vec_id", "score")
        return pa.table(dict(zip(names, ([r[c] for r in out] for c in range(4)), strict=True)), schema=pa.schema([(c, pa.int64()) for c in names]))

    floors = lambda bound: lambda state: state.groupBy("group").agg(F.min(bound).alias("floor"))

    def with_bounds(anchors: DataFrame, found: DataFrame | None):  # noqa: ANN202
        if found is None:
            return anchors.withColumn("bound", F.lit(float("-inf"))), floors("bound")
        bound = found.groupBy("anchor_id").agg(F.when(F.count("*") == K, F.min("score")).cast("double").alias("bound"))
        return anchors.join(bound, "anchor_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))), floors("bound")

    positives = _rounds(scratch, placed, units, anchors, scan_positives, "anchor_id long, vec_id long, score long", ["anchor_id"], with_bounds)
    positives = scratch.cut(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    def with_intervals(anchors: DataFrame, found: DataFrame | None):  # noqa: ANN202
        rows_ = positives.withColumn("bound", least_negative(F.col("positive_score")))
        if found is not None:
            reached = found.groupBy("anchor_id", "positive_id").agg(F.when(F.count("*") == K, F.min("score")).alias("reached"))
            rows_ = rows_.join(reached, ["anchor_id", "positive_id"], "left").withColumn("bound", F.greatest("bound", "reached"))
        lists = rows_.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score", "bound")).alias("all"))  # at most K
        lists = lists.select("anchor_id", F.col("all.positive_id").alias("positives"), F.col("all.positive_score").alias("above"), F.col("all.bound").alias("bounds"))
        return anchors.join(lists, "anchor_id"), floors(F.array_min("bounds"))

    negatives = _rounds(scratch, placed, units, anchors, scan_negatives, "anchor_id long, positive_id long, vec_id long, score long", ["anchor_id", "positive_id"], with_intervals)
    pairs = negatives.join(positives, ["anchor_id", "positive_id"])
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("anchor_id", "positive_id", rank.alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"), relabel=relabelled)


_SQL = """
WITH fine AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM ranked WHERE rank <= 5
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {"op12_hard_negatives": _SQL}
