"""Chunks of files kept from batch to batch, by a manifest of what each file had.

A batch holds all chunks of the files that changed. Where a file's chunks begin with all that it had, only what follows is added; any other
change (or a file that has none left) builds the table anew without the old ones. Every batch is a version; the pointer moves last and
names the batch, so a batch that comes again, or one that broke off before the pointer, leaves no trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.versions import Versions

KEY = ["path", "chunk_index"]


def plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action, had, has) of files in ``new`` against ``old``, both (path, chunk_index, sha): add, same, append or rebuild. A row without an index stands for a file without chunks."""
    was = old.join(new.select("path").distinct(), "path", "left_semi").withColumnRenamed("sha", "was")
    both = was.join(new.filter("chunk_index is not null"), KEY, "full_outer")
    files = both.groupBy("path").agg(F.count("was").alias("had"), F.count("sha").alias("has"), F.count_if(F.col("was") == F.col("sha")).alias("kept"))
    action = F.when(F.col("had") == 0, "add").when(F.col("kept") < F.col("had"), "rebuild").when(F.col("has") > F.col("had"), "append").otherwise("same")
    return files.select("path", action.alias("action"), "had", "has")


class ChunkStore:
    """The chunks below ``path``: (path, chunk_index, sha, chunk)."""

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path)

    def read(self) -> DataFrame:
        return self.versions.read("chunks", *self.versions.state()["live"]).select(*KEY, "sha", "chunk")

    def apply(self, batch: DataFrame, batch_id: int) -> dict[str, int]:
        """Take in a batch (path, chunk_index, chunk); how many files it adds to, leaves, appends to and builds anew, or nothing if it was taken in before."""
        state = self.versions.state()
        if state and batch_id <= state["batch"]:
            return {}
        version = state["version"] + 1 if state else 0
        new = batch.select(*KEY, F.sha2(F.col("chunk").cast("binary"), 256).alias("sha"), "chunk")
        self.versions.write(new, "batch", version)
        new = self.versions.read("batch", version).drop("version")
        old = self.read() if state else new.limit(0)
        self.versions.write(plan(old.select(*KEY, "sha"), new.select(*KEY, "sha")), "plan", version)
        planned = self.versions.read("plan", version)
        counts = {r.action: r["count"] for r in planned.groupBy("action").count().collect()}  # four rows at most
        there = new.filter("chunk_index is not null")
        live = state["live"] if state else []
        if counts.get("rebuild"):
            rest = old.join(planned.filter("action = 'rebuild'").select("path"), "path", "left_anti")
            self.versions.write(rest.unionByName(there.join(rest.select(*KEY), KEY, "left_anti")), "chunks", version)
            live = [version]
        elif counts.get("add") or counts.get("append"):
            self.versions.write(there.join(old.select(*KEY), KEY, "left_anti"), "chunks", version)
            live = [*live, version]
        self.versions.move(version, live=live, batch=batch_id)
        return counts

    def sink(self):  # noqa: ANN201
        """A function for ``foreachBatch``."""
        return lambda batch, batch_id: self.apply(batch, batch_id)
