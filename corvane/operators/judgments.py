"""Judgments: sources named by paths, their ends or globs, and feedback that is promoted to a fixture."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import glob_pattern
from corvane.runtime import importable

#: What makes a pattern a glob, in a segment of it.
GLOB = r"[*?\[{]"


def matched(paths: DataFrame, patterns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of ``paths`` beside each of ``patterns`` that names them: the whole path, its last segments, or a glob that matches it.

    A path is met by its ends, each a key, so naming by path or end is a join on equal keys. A glob is met by a part of it that is fixed: its
    last segment, its first one, or what its last segment ends in after the last dot; the few without any meet all paths. Globs are verified then.
    """
    importable(paths.sparkSession)
    named = paths.withColumn("__segments", F.split(path, "/"))
    ends = F.transform(F.sequence(F.lit(1), F.size("__segments")), lambda i: F.array_join(F.slice("__segments", i, F.size("__segments")), "/"))
    literal = named.withColumn("__key", F.explode(F.array_distinct(ends))).join(patterns.withColumn("__key", F.col(pattern)), "__key").drop("__key", "__segments")

    @F.pandas_udf("string")
    def form(globs: pd.Series) -> pd.Series:
        return globs.map(glob_pattern)

    globs = patterns.filter(F.col(pattern).rlike(GLOB)).withColumn("__form", form(F.col(pattern))).withColumn("__parts", F.split(pattern, "/"))
    head, tail = F.get("__parts", F.lit(0)), F.element_at("__parts", -1)
    # braces may hold slashes, so that what stands before or after them is no whole segment
    whole = ~F.col(pattern).rlike(r"\{[^}]*/")
    suffix = F.regexp_extract(tail, r"\.([^.*?\[\]{},]+)$", 1)
    kind = F.when(whole & ~tail.rlike(GLOB), F.concat(F.lit("tail:"), tail)).when(whole & (F.size("__parts") > 1) & ~head.rlike(GLOB), F.concat(F.lit("head:"), head)).when(whole & (suffix != ""), F.concat(F.lit("suffix:"), suffix)).otherwise(F.lit("any"))
    last, first = F.element_at("__segments", -1), F.get("__segments", F.lit(0))
    keys = F.array(F.concat(F.lit("tail:"), last), F.concat(F.lit("head:"), first), F.concat(F.lit("suffix:"), F.substring_index(last, ".", -1)), F.lit("any"))
    met = named.withColumn("__key", F.explode(keys)).join(globs.withColumn("__key", kind), "__key").filter(F.rlike(F.col(path), F.col("__form"))).drop("__key", "__segments", "__form", "__parts")
    return literal.unionByName(met).distinct()


def promoted(feedback: DataFrame, keys: list[str], created: str, order: str) -> DataFrame:
    """For each source (``keys``): whether it is required or forbidden, its relevance, the entry that decided, and the groups of all its positive entries.

    A positive entry is a relevant one of some relevance. The strongest decides, the latest among equals, and the later entry among those; any positive
    entry cancels the negative ones, before and after it. Without any the latest entry forbids the source.
    """
    positive = (F.col("relevance") > 0) & (F.col("verdict") == "relevant")
    best = F.max(F.when(positive, F.struct("relevance", created, order)))
    s = feedback.groupBy(*keys).agg(
        F.coalesce(F.bool_or(positive), F.lit(False)).alias("required"), best.alias("best"), F.max(F.struct(created, order)).alias("latest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(positive, F.col("groups")))))).alias("groups"),
    )
    return s.select(*keys, "required", F.col("best.relevance").alias("relevance"), F.when(F.col("required"), F.col(f"best.{order}")).otherwise(F.col(f"latest.{order}")).alias("decided_by"), F.when(F.col("required"), F.col("groups")).alias("groups"))
