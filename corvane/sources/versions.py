"""Tables in versions beside each other, with a pointer that moves last.

A version's tables are written first and named by nothing; the pointer is one row more, written when all of them stand, so
a reader sees the old version or the new one, whole. Writing a version again overwrites it, so a repeated batch changes nothing.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """The versions below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def states(self) -> list[dict]:
        """What the pointer has said, oldest first."""
        try:
            rows = self.spark.read.text(f"{self.path}/pointer/*").collect()  # one short row a version
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((json.loads(r.value) for r in rows), key=lambda s: s["version"])

    def state(self) -> dict | None:
        """What the pointer says now."""
        return next(iter(self.states()[-1:]), None)

    def move(self, version: int, **state: object) -> dict:
        """Let the pointer name ``version``; its tables must stand."""
        said = {"version": version, **state}
        self.spark.range(1).select(F.lit(json.dumps(said)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/pointer/{version:09d}")
        return said

    def write(self, df: DataFrame, name: str, version: int, *partition_by: str) -> None:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{name}/version={version}")

    def read(self, name: str, *versions: int) -> DataFrame:
        """Rows of a table in some versions, with the column ``version``."""
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/version={v}" for v in versions])


def fingerprint(files: DataFrame) -> str:
    """A hash of the names, sizes and times of the files that a DataFrame reads; no column of them is read."""
    m = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    r = m.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*m.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}-{r.h}"
