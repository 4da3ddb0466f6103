"""Retrieval metrics, comparisons of runs, and significance, as grouped aggregates over ranked rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beir(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query with a relevant judgment: ndcg_10, map_100, p_10, r_10, r_100; a repeated document counts at its first rank."""
    levels = qrels.filter("relevance > 0").groupBy("query_id", "relevance").agg(F.count("*").alias("n"))
    return scored(first_ranks(run).join(qrels, ["query_id", "id"], "left"), levels)


def first_ranks(run: DataFrame) -> DataFrame:
    """(query_id, id, rank) of a run without repeated documents; ranks close up."""
    first = run.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def scored(judged: DataFrame, levels: DataFrame) -> DataFrame:
    """``beir`` of ranked rows with their ``relevance`` (null: none), and of the number ``n`` of a query's judgments of each relevance above 0.

    The best ranking has a level's judgments one after the other, so it is known from their numbers and judgments need not be sorted.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    judged = judged.withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    hits = judged.withColumn("hits", F.sum((F.col("relevance") > 0).cast("int")).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    worth = F.pow(F.lit(2.0), "relevance") - 1
    rel = F.col("relevance") > 0
    got = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, worth / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.when(rel & (F.col("rank") <= 100), F.col("hits") / F.col("rank"))).alias("ap"),
        F.count_if(rel & (F.col("rank") <= 10)).alias("h10"), F.count_if(rel & (F.col("rank") <= 100)).alias("h100"),
    )
    better = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("relevance")).rowsBetween(Window.unboundedPreceding, -1))
    placed = levels.withColumn("better", F.coalesce(better, F.lit(0))).withColumn("last", F.least(F.lit(10), F.col("better") + F.col("n")))
    gain = F.when(F.col("better") < 10, F.aggregate(F.sequence(F.col("better") + 1, "last"), F.lit(0.0), lambda s, place: s + worth / F.log2(place + 1)))
    ideal = placed.groupBy("query_id").agg(F.sum(gain).alias("idcg"), F.sum("n").alias("relevant"))
    r6 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return ideal.join(got, "query_id", "left").select(
        "query_id", r6(F.col("dcg") / F.col("idcg")).alias("ndcg_10"), r6(F.col("ap") / F.col("relevant")).alias("map_100"), r6(F.col("h10") / 10.0).alias("p_10"),
        r6(F.col("h10") / F.col("relevant")).alias("r_10"), r6(F.col("h100") / F.col("relevant")).alias("r_100"),
    )


def once(run: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """Per judged query: metrics of (query_id, source, rank) where a judgment (query_id, source, relevance) matches once, at the source's first rank."""
    first = run.groupBy("query_id", "source").agg(F.min("rank").alias("rank")).join(judgments, ["query_id", "source"])
    hits = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gain = lambda place: (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col(place) + 1)
    inside = F.col("rank") <= k
    precision = F.col("nth") / F.col("rank")
    got = hits.groupBy("query_id").agg(F.sum(F.when(inside, gain("rank"))).alias("dcg"), F.min("rank").alias("first"), F.count_if(inside).alias("found"), F.sum(precision).alias("ap"), F.sum(F.when(inside, precision)).alias("ap_k"))
    by_worth = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "source")
    ideal = judgments.withColumn("p", F.row_number().over(by_worth)).groupBy("query_id").agg(F.sum(F.when(F.col("p") <= k, gain("p"))).alias("ideal"), F.count("*").alias("judged"))
    r6 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return ideal.join(got, "query_id", "left").select(
        "query_id", r6(F.col("dcg") / F.col("ideal")).alias(f"ndcg_{k}"), r6(F.when(F.col("first") <= k, 1 / F.col("first"))).alias(f"mrr_{k}"), r6(F.col("found") / F.col("judged")).alias(f"recall_{k}"),
        r6(F.col("found") / F.lit(k)).alias(f"precision_{k}"), r6(F.col("ap") / F.col("judged")).alias("map"), r6(F.col("ap_k") / F.least("judged", F.lit(k))).alias(f"map_{k}"), (F.coalesce("found", F.lit(0)) > 0).alias("hit"),
    )


def nearest_ranks(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group, from running counts of its distinct values; no group is held in a buffer."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    running = counts.withColumns({"__up": F.sum("__n").over(Window.partitionBy(*keys).orderBy(value)), "__all": F.sum("__n").over(Window.partitionBy(*keys))})
    return running.groupBy(*keys).agg(*[F.min(F.when(F.col("__up") >= F.ceil(F.col("__all") * p), F.col(value))).alias(name) for name, p in shares.items()])


def compare_runs(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """Full outer join of two runs: ranks, their delta, and whether a row is new, dropped, moved or stable."""
    a, b = before.select("query_id", "id", F.col("rank").alias("before_rank")), after.select("query_id", "id", F.col("rank").alias("after_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    status = F.when(F.col("before_rank").isNull(), "new").when(F.col("after_rank").isNull(), "dropped").when(F.col("before_rank") == F.col("after_rank"), "stable").otherwise("moved")
    missing = lambda c: F.coalesce(c, F.lit(k + 1))
    return both.withColumns({"status": status, "rank_delta": F.col("after_rank") - F.col("before_rank"), "absolute_rank_delta": F.abs(missing("after_rank") - missing("before_rank"))})


def kendall(compared: DataFrame, k: int) -> DataFrame:
    """Per query: share of comparable pairs in the same order before and after; what is absent stands after all else. At most 2k ids a query are paired."""
    effective = compared.select("query_id", "id", F.coalesce("before_rank", F.lit(k + 1)).alias("b"), F.coalesce("after_rank", F.lit(k + 1)).alias("a"))
    x, y = effective.alias("x"), effective.alias("y")
    pairs = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.query_id").alias("query_id"), F.signum(F.col("x.b") - F.col("y.b")).alias("sb"), F.signum(F.col("x.a") - F.col("y.a")).alias("sa"))
    counts = pairs.filter("sb <> 0 and sa <> 0").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("sb") != F.col("sa")).alias("d"))
    return effective.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", F.round(F.coalesce(1 - F.col("d") / F.col("n"), F.lit(1.0)), 6).alias("stability"))


def holm(tests: DataFrame, p: str = "p", tie: str = "id") -> DataFrame:
    """Step-down adjusted p-values of one family."""
    order = Window.orderBy(p, tie)
    scaled = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1))
    return tests.withColumn("scaled", scaled).withColumn("holm", F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("scaled")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def t_test_p(mean: float, sd: float, n: int) -> float:
    """Two-sided p-value of a paired t-test; without spread, 1 for no difference and 0 for a constant one."""
    if n < 2 or sd == 0:
        return 1.0 if n < 2 or mean == 0 else 0.0
    t, df = mean / (sd / math.sqrt(n)), n - 1
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
