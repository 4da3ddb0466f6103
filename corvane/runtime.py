"""Reading tables, folders that executors share, and letting Python workers find the package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables of the library go if the session names no shared folder (one machine).
LOCAL_TABLES = "/tmp/checkpoints"


def importable(spark: SparkSession) -> None:
    """Workers on this machine find the package wherever the driver was started; clusters ship it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder; executors need one that they share")
    return (path or LOCAL_TABLES).rstrip("/")


def stable_name(spark: SparkSession, *parts: str) -> str:
    """A name for a folder that stands for ``parts``."""
    return spark.range(1).select(F.sha2(F.lit("\n".join(parts)), 256)).first()[0]
