"""Ranked lists: fusion, knees, collapsed views, neighbours, diversification, packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.lexical import top
from corvane.runtime import importable

RRF_C = 60
DIGITS = 9
NEIGHBOUR_CAP = 50


def fuse(runs: DataFrame, k: int | None = None, c: int = RRF_C) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, list, weight, id, rank): best rank in each list; ties by list, rank and id."""
    # an exchange of its own: a union of lists that are partitioned alike must not stand for one, as its parts may be coalesced apart
    best = runs.filter("weight > 0").repartition("query_id").groupBy("query_id", "list", "weight", "id").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (c + F.col("rank"))), DIGITS).alias("score"), F.min(F.struct("list", "rank")).alias("first"), F.count("*").alias("lists"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).drop("first")
    return ranked.filter(F.col("rank") <= k) if k else ranked


def compose(pools: DataFrame, k: int, penalty: float = 1.25) -> DataFrame:
    """Composed retrieval from (query_id, role, weight, id, rank, score): support of primary and plus lists by reciprocal rank, less the strongest of the minus lists.

    What only minus lists hold is no candidate. Ties go to the better primary rank, the better score, and the smaller id.
    """
    positive = F.col("role").isin("primary", "plus")
    share = F.col("weight") / F.col("rank")
    both = pools.repartition("query_id").groupBy("query_id", "id").agg(
        F.sum(F.when(positive, share)).alias("support"), F.max(F.when(~positive, share)).alias("against"), F.min(F.when(F.col("role") == "primary", F.col("rank"))).alias("first"), F.min(F.when(positive, F.col("score"))).alias("best")
    )
    scored = both.filter("support > 0").withColumn("score", F.round(F.col("support") - penalty * F.coalesce("against", F.lit(0.0)), DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("first"), "best", "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def knee(run: DataFrame, score: str = "score") -> DataFrame:
    """Per query, the threshold at the largest gap of ascending scores, and what it keeps; no knee if no gap stands out."""
    order = Window.partitionBy("query_id").orderBy(score, "id")
    gaps = run.withColumns({"gap": F.lead(score).over(order) - F.col(score), "i": F.row_number().over(order) - 1})
    whole = gaps.groupBy("query_id").agg(
        F.max(score).alias("last"), F.count("*").alias("n"), F.max("gap").alias("most"), F.avg("gap").alias("mean"),
        F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("i")).alias("i"), F.col(score).alias("at")))).alias("top"),
    )
    none = F.col("most").isNull() | (F.col("most") <= F.col("mean") * 1.1)
    return whole.select("query_id", F.round(F.when(none, F.col("last")).otherwise(F.col("top.at")), 6).alias("threshold"), F.when(~none, (-F.col("top.i")).cast("long")).alias("knee_index"), F.when(none, F.col("n")).otherwise(1 - F.col("top.i")).cast("long").alias("kept"))


def collapse_views(hits: DataFrame, higher: bool = False) -> DataFrame:
    """One row per (query_id, canonical_id): the best score, strengthened by further hits; a passage stands for the rest."""
    boost = 1 + F.least(F.count("*") - 1, F.lit(6)) * 0.05
    best = F.max("score") * boost if higher else F.min("score") / boost
    return hits.groupBy("query_id", "canonical_id").agg(F.round(best, 6).alias("score"), F.count("*").alias("hits"), F.min_by("id", F.struct((F.col("kind") != "passage").alias("view"), "rank")).alias("representative"))


def neighbours(hits: DataFrame, chunks: DataFrame, before: int, after: int, cap: int = NEIGHBOUR_CAP) -> DataFrame:
    """Chunks around each hit (query_id, source, idx, rank), claimed by the best hit, without hits themselves, at most ``cap`` a query; met by equal keys, one for each place around a hit."""
    around = hits.select("query_id", "source", "rank", F.explode(F.sequence(F.col("idx") - before, F.col("idx") + after)).alias("idx"))
    around = around.join(hits.select("query_id", "source", "idx"), ["query_id", "source", "idx"], "left_anti")
    near = chunks.select("source", "idx").join(around, ["source", "idx"]).select("query_id", "rank", "source", "idx")
    claimed = near.groupBy("query_id", "source", "idx").agg(F.min("rank").alias("claimed_by"))
    order = Window.partitionBy("query_id").orderBy("claimed_by", "source", "idx")
    return claimed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).drop("n")


def diversify(candidates: DataFrame, k: int, same_source: float = 0.35, overlap: float = 0.28) -> DataFrame:
    """Greedy selection from (query_id, id, source, base, tokens): base less the largest penalty of what is selected already.

    A query has at most a hundred candidates, so the fold runs in one group a query.
    """
    importable(candidates.sparkSession)

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf.sort_values(["base", "id"], ascending=[False, True]).to_dict("records")
        out: list[dict] = []
        for row in rest:
            row["set"] = set(row["tokens"])
        while rest and len(out) < k:
            def value(row):  # noqa: ANN001, ANN202
                penalty = 0.0
                for s in out:
                    union = len(row["set"] | s["set"])
                    penalty = max(penalty, same_source if row["source"] == s["source"] else 0.0, overlap * (len(row["set"] & s["set"]) / union if union else 0.0))
                return row["base"] - penalty

            scored = [(value(r), -i) for i, r in enumerate(rest)]
            best = max(scored)
            row = rest.pop(-best[1])
            out.append({**row, "score": round(best[0], 6), "rank": len(out) + 1})
        return pd.DataFrame([{c: r[c] for c in ("query_id", "id", "score", "rank")} for r in out], columns=["query_id", "id", "score", "rank"])

    return candidates.groupBy("query_id").applyInPandas(select, "query_id long, id long, score double, rank int")


def pack(run: DataFrame, budget: int) -> DataFrame:
    """Context packing in rank order: a chunk that doesn't fit is left out and takes nothing from the budget. (query_id, id, rank, tokens) -> included ids and tokens used."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "tokens")))
    fold = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids")),
        lambda a, x: F.when(a["used"] + x["tokens"] <= budget, F.struct((a["used"] + x["tokens"]).alias("used"), F.concat(a["ids"], F.array(x["id"].cast("long"))).alias("ids"))).otherwise(a),
    )
    packed = run.groupBy("query_id").agg(fold.alias("p"), F.count("*").alias("offered"))
    return packed.select("query_id", F.col("p.used").alias("used"), F.array_join("p.ids", ",").alias("included"), (F.col("offered") - F.size("p.ids")).alias("excluded"))


__all__ = ["Column", "collapse_views", "diversify", "fuse", "knee", "neighbours", "pack", "top"]
