"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go if the session names no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Seconds between collections of the driver's garbage.
COLLECT_EVERY = 5.0
#: Java pattern of white space in all contracts of this subpackage; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is set only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder; executors need one that they share")
        path = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder so that a lost executor costs no recomputation.

    ``cut`` writes a DataFrame as Parquet and reads it back, which cuts its lineage; ``drop`` removes tables that
    nothing reads any more, and lets Spark remove the shuffle files of plans that are out of use. What is left when the
    driver ends goes with it.
    """

    collected = 0.0

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        if self.count == 1:
            self._path(self.base)[1].deleteOnExit(self._path(self.base)[0])
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.collect()
        return out

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def collect(self) -> None:
        """Spark removes the shuffle files of a finished plan when the driver's JVM collects it; steps that take no time needn't wait for that."""
        if time.monotonic() - Scratch.collected < COLLECT_EVERY:
            return
        Scratch.collected = time.monotonic()
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, files = self._path(table._scratch_path)
            files.delete(path, True)
        self.collect()


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package, wherever the driver was started; clusters ship it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def fold_key(column: Column | str) -> Column:
    """crc32 of an id written as text, as the contracts' train and test folds use it."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def in_lengths(lengths, most: int = 2_000_000):  # noqa: ANN001, ANN201
    """Cut a list into slices of bounded total length: (start, end) pairs; a long member stands alone."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def in_batches(texts, most_chars: int = 2_000_000):  # noqa: ANN001, ANN201
    """The slices of a list of strings."""
    return in_lengths([len(t) if t else 0 for t in texts], most_chars)
