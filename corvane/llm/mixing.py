"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed per cell (source, language, topic) and raked: the tokens that a mix keeps of each cell are scaled
to the target marginals of each dimension in turn until all of them hold, under the bound that no cell gives more tokens
than it has. A document of a cell is then kept with probability ``kept / weight`` of its cell, so that the expected marginals
are the targets themselves, bound cells included. The draw is a hash of the document, so that it doesn't depend on
partitions or on retries.

Targets default to the corpus' own shares raised to ``TEMPERATURE``, which lifts small categories; together they ask for
``BUDGET`` of the corpus' tokens. A category that has fewer tokens than its target gives all of them, and the others share
what is missing in proportion to their targets: these are the marginals that can be reached. The topic is the form of a text
(table, symbols, dialogue, note, article, book) unless the caller names a column. ``marginals`` tells targets and what is kept.

Cells are raked on the driver while there are at most ``DRIVER_CELLS`` of them, and as a table beyond that, by the same
rule: until no marginal is off by more than ``TOLERANCE`` of its target. Targets that no weights of the cells can meet
together end where ``STALL`` rounds bring the largest error down by less than a tenth; one scale for all cells then still
meets the budget.

Defined results: null categories are a category of their own. Null and empty texts weigh nothing; a cell without tokens
keeps its documents with probability 1. Texts of any length count whole. Repeated rows share a draw. An empty table gives an
empty result. Extra columns stay, but for those named ``__tokens``, ``__source``, ``__lang``, ``__topic``, ``__prob`` and
``__kept``, which are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, read, words_of

TEMPERATURE = 0.5
#: Share of the corpus' tokens that a mix is expected to keep.
BUDGET = 0.5
#: Largest error of a marginal, relative to its target.
TOLERANCE = 1e-6
STALL = 50
DRIVER_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")
_NONE = "\x00none"


def topic_of(text: Column, tokens: Column) -> Column:
    """Form of a text, from counts of built-in functions."""
    symbols = F.regexp_count(text, F.lit(r"[#$%&*]"))
    bars = F.regexp_count(text, F.lit(r"[|]"))
    marks = F.regexp_count(text, F.lit(r"[!?]"))
    return (
        F.when(bars * 4 > tokens, "table").when(symbols * 4 > tokens, "symbols").when(marks * 4 > tokens, "dialogue").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("book")
    )


def weigh(df: DataFrame, topic: str | None = None) -> DataFrame:
    """Add ``__tokens`` and the cell columns ``__source``, ``__lang``, ``__topic``."""
    df = df.drop("__tokens", "__prob", "__kept").withColumn("__tokens", F.size(words_of(F.col("text"))).cast("long"))
    form = F.col(topic).cast("string") if topic else topic_of(F.coalesce("text", F.lit("")), F.col("__tokens"))
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(_NONE))
    return df.withColumns({"__source": cell(F.col("source")), "__lang": cell(F.col("lang")), "__topic": cell(form)})


def _targets(values: list[str], shares: np.ndarray, wanted: dict[str, float] | None) -> np.ndarray:
    raw = np.array([wanted.get(v, 0.0) for v in values]) if wanted else shares**TEMPERATURE
    return raw / raw.sum() if raw.sum() else raw


def _settled(errors: list[float]) -> bool:
    """Whether raking ends, from the largest error after each round."""
    return errors[-1] <= TOLERANCE or (len(errors) > STALL and errors[-1] > 0.9 * errors[-1 - STALL])


def rake(codes: list[np.ndarray], weights: np.ndarray, targets: list[np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """Cell weights with the given marginals, from starting ``weights`` and of at most ``most``; ``codes`` are the cells' categories by dimension."""
    most = np.full(len(weights), np.inf) if most is None else most
    free = weights.astype(float)  # what the scales of all dimensions make of a cell, before its bound
    errors: list[float] = []
    while not errors or not _settled(errors):
        for code, target in zip(codes, targets, strict=True):
            bound = free >= most
            held = np.bincount(code[bound], most[bound], len(target))
            rest = np.bincount(code[~bound], free[~bound], len(target))
            up = (target >= held + rest) & (rest > 0)
            free = free * np.where(up, np.divide(target - held, rest, out=np.ones_like(target), where=up), np.divide(target, held + rest, out=np.zeros_like(target), where=held + rest > 0))[code]
        fitted = np.minimum(free, most)
        off = [np.abs(np.bincount(code, fitted, len(target))[target > 0] / target[target > 0] - 1) for code, target in zip(codes, targets, strict=True)]
        errors.append(max((float(e.max()) for e in off if len(e)), default=0.0))
    return fitted


def calibrate(ratio: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """The scale c at which ``sum(weights * min(1, c * ratio))`` is the budget."""
    low, high = 0.0, 1.0
    while (weights * np.minimum(1, high * ratio)).sum() < budget and high < 1e18:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (weights * np.minimum(1, mid * ratio)).sum() < budget else (low, mid)
    return high


def reachable(shares: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Tokens of each category: in proportion to ``shares``, at most its ``weights``, ``budget`` in all if there are as many."""
    ratio = np.divide(shares, weights, out=np.zeros_like(shares), where=weights > 0)
    return weights * np.minimum(1, calibrate(ratio, weights, min(budget, weights[shares > 0].sum()) * (1 - 1e-12)) * ratio)


def _rake_on_driver(cells: DataFrame, wanted: dict[str, dict[str, float]], budget: float) -> DataFrame:
    names = [f"__{d}" for d in DIMENSIONS]
    rows = sorted(tuple(r) for r in cells.select(*names, F.col("w").cast("double")).collect())
    weights = np.array([r[3] for r in rows])
    codes, targets = [], []
    for i, d in enumerate(DIMENSIONS):
        values = sorted({r[i] for r in rows})
        place = {v: k for k, v in enumerate(values)}
        code = np.array([place[r[i]] for r in rows])
        have = np.bincount(code, weights, len(values))
        codes.append(code)
        targets.append(reachable(_targets(values, have / weights.sum(), wanted.get(d)), have, budget * weights.sum()))
    ratio = rake(codes, weights * budget, targets, weights) / weights
    probs = np.minimum(1, calibrate(ratio, weights, budget * weights.sum()) * ratio)
    schema = ", ".join(f"{n} string" for n in names) + ", __prob double"
    return cells.sparkSession.createDataFrame([(*r[:3], float(p)) for r, p in zip(rows, probs, strict=True)], schema)


def _scale(df: DataFrame, budget: float) -> float:
    """``calibrate`` for a table with the columns r (ratio) and w (weight): some sums in each of a few passes."""
    kept = lambda c: F.sum(F.col("w") * F.least(F.lit(1.0), F.lit(c) * F.col("r")))
    low, high = 0.0, 1.0
    while (df.agg(kept(high)).first()[0] or 0.0) < budget and high < 1e18:
        high *= 2
    for _ in range(20):
        mids = [low + (high - low) * i / 9 for i in range(1, 9)]
        under = sum(s < budget for s in df.agg(*map(kept, mids)).first())
        low, high = (mids[under - 1] if under else low), (mids[under] if under < 8 else high)
        if high - low < 1e-12 * high:
            break
    return high


def _rake_as_table(cells: DataFrame, wanted: dict[str, dict[str, float]], budget: float, scratch: Scratch) -> DataFrame:
    spark = cells.sparkSession
    total = cells.agg(F.sum("w")).first()[0]
    goals = {}
    for d in DIMENSIONS:
        shares = cells.groupBy(f"__{d}").agg(F.sum("w").cast("double").alias("w"))
        if wanted.get(d):
            shares = shares.join(spark.createDataFrame(list(wanted[d].items()), f"__{d} string, t double"), f"__{d}", "left").fillna(0.0, "t")
        else:
            shares = shares.withColumn("t", F.pow(F.col("w") / total, F.lit(TEMPERATURE)))
        goal = scratch.cut(shares.withColumn("r", F.col("t") / F.col("w")))
        c = _scale(goal, min(budget * total, goal.agg(F.sum(F.when(F.col("t") > 0, F.col("w")))).first()[0] or 0.0) * (1 - 1e-12))
        goals[d] = scratch.cut(goal.select(f"__{d}", (F.col("w") * F.least(F.lit(1.0), F.lit(c) * F.col("r"))).alias("t")))
        scratch.drop(goal)
    fitted = cells.withColumn("f", F.col("w") * budget)
    errors: list[float] = []
    while not errors or not _settled(errors):
        before = fitted
        for d in DIMENSIONS:
            bound = F.col("f") >= F.col("w")
            have = fitted.groupBy(f"__{d}").agg(F.sum(F.when(bound, F.col("w")).otherwise(0.0)).alias("held"), F.sum(F.when(bound, 0.0).otherwise(F.col("f"))).alias("rest")).join(goals[d], f"__{d}")
            whole = F.col("held") + F.col("rest")
            up = (F.col("t") >= whole) & (F.col("rest") > 0)
            scale = have.select(f"__{d}", F.when(up, (F.col("t") - F.col("held")) / F.col("rest")).when(whole > 0, F.col("t") / whole).otherwise(0.0).alias("scale"))
            fitted = fitted.join(scale, f"__{d}").withColumn("f", F.col("f") * F.col("scale")).drop("scale")
        fitted = scratch.cut(fitted)
        if errors:
            scratch.drop(before)
        off = [fitted.groupBy(f"__{d}").agg(F.sum(F.least("f", F.col("w").cast("double"))).alias("have")).join(goals[d], f"__{d}").filter("t > 0").select(F.abs(F.col("have") / F.col("t") - 1).alias("e")) for d in DIMENSIONS]
        errors.append(off[0].unionAll(off[1]).unionAll(off[2]).agg(F.max("e")).first()[0] or 0.0)
    ratio = fitted.withColumn("r", F.least(F.lit(1.0), F.col("f") / F.col("w")))
    c = _scale(ratio, budget * total)
    scratch.drop(*goals.values())
    return ratio.select(*(f"__{d}" for d in DIMENSIONS), F.least(F.lit(1.0), F.lit(c) * F.col("r")).alias("__prob"))


def marginals(mixed: DataFrame, dimension: str) -> DataFrame:
    """Of each category of a mix: tokens, those that it is expected to keep, and those that were kept."""
    kept = F.when(F.col("__kept"), F.col("__tokens")).otherwise(0)
    return mixed.groupBy(f"__{dimension}").agg(F.sum("__tokens").alias("tokens"), F.sum(F.col("__tokens") * F.col("__prob")).alias("expected"), F.sum(kept).alias("kept"))


def mix(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, topic: str | None = None, seed: int = 29, most_cells: int = DRIVER_CELLS) -> DataFrame:
    """Add ``__tokens``, the cell columns, ``__prob`` and ``__kept`` to documents (doc_id, text, source, lang, ...)."""
    scratch = Scratch(df.sparkSession, "mixing")
    weighed = weigh(df, topic)
    names = [f"__{d}" for d in DIMENSIONS]
    cells = scratch.cut(weighed.groupBy(*names).agg(F.sum("__tokens").alias("w")).filter("w > 0"))
    count = cells.count()
    if count == 0:
        probs = cells.select(*names, F.lit(1.0).alias("__prob"))
    elif count <= most_cells:
        probs = F.broadcast(_rake_on_driver(cells, targets or {}, budget))  # at most DRIVER_CELLS rows
    else:
        probs = _rake_as_table(cells, targets or {}, budget, scratch)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce("text", F.lit("")))), 11) * 2.0**-53
    return weighed.join(probs, names, "left").withColumn("__prob", F.coalesce("__prob", F.lit(1.0))).withColumn("__kept", draw < F.col("__prob"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """One row per document: its cell, tokens, calibrated probability and whether the mix keeps it."""
    mixed = mix(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.col("__prob").alias("prob"), F.col("__kept").alias("kept"))


QUERIES = {"op2_mix_sources": op2_mix_sources}
SQL: dict[str, str] = {}
