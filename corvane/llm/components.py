"""Distributed connected components by alternating large-star and small-star steps.

Labels, links and components stay in tables of the shared folder; the driver sees one count per round, of nodes that stand in
no star yet. Each step needs the least neighbour of a node, which is pre-aggregated, so a hub is no unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) is either the centre of its star, or hangs on one centre alone."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.agg(F.count(F.when((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1)), 1))).first()[0] == 0


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From links (a, b), ``(node, component)`` for every node that has a link; ``component`` is the least node reachable.

    Repeated links, links both ways and loops are fine; links with a null end are none. No links give an empty result.
    """
    a, b = F.col("a"), F.col("b")
    current = scratch.cut(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _are_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # an edge (u, m) goes with every u, also where only greater neighbours were rewritten
        new = scratch.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct())
        scratch.drop(current)
        current = new
    ends = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return scratch.cut(ends.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def merged_components(parts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components ``parts`` (node, component) after more links (a, b): only components are linked anew, not their nodes."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    into = connected_components(between.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")), scratch)
    moved = parts.join(into.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    moved = moved.select("node", F.coalesce("into", "component").alias("component"))
    out = scratch.cut(moved.unionByName(into.join(parts.select("node"), "node", "left_anti")))
    scratch.drop(into, parts)
    return out
