"""Streams: incremental ingest, log tails, debounced changes, breakers and retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.runtime import importable


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def log_tail(logs: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, errors and mean values of events in tumbling windows; late rows wait for the watermark."""
    return logs.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("window.start", "event_type", "n", "mean")


def coalesced_changes(changes: DataFrame, gap: str = "250 milliseconds", late: str = "1 minute") -> DataFrame:
    """File changes (kb, path, ts) debounced: one row per file for each burst without a gap."""
    return changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "kb", "path").agg(F.count("*").alias("events")).select("kb", "path", "session_window.start", "session_window.end", "events")


def ingest_batch(target: str):  # noqa: ANN201
    """A ``foreachBatch`` function: rows whose (id, sha) the target lacks are appended, once each, so a repeated batch adds nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["id", "sha"])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(target).select("id", "sha"), ["id", "sha"], "left_anti")
        new.write.mode("append").parquet(target)

    return run


def ingest(documents: DataFrame, target: str, checkpoint: str):  # noqa: ANN201
    """Run what has arrived and stop (``AvailableNow``): the poll of a trigger file becomes a scheduled job."""
    rows = documents.select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "source")
    return rows.writeStream.foreachBatch(ingest_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BREAKER_SCHEMA = "provider long, event_id long, state string"


def breaker(events: DataFrame, failures: int = 3, cooldown: float = 30.0) -> DataFrame:
    """Circuit breaker over ordered calls (provider, event_id, at, ok): the state in which each call meets the provider.

    A provider's calls depend on each other in order: they are sorted within its partition and folded batch by batch, so that
    memory holds one batch and the state of one provider, however long its history is.
    """
    importable(events.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, bad, opened = None, 0, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.provider != provider:
                    provider, bad, opened = r.provider, 0, None
                state = "closed" if opened is None else "open" if r.at - opened < cooldown else "half_open"
                out.append((r.provider, r.event_id, state))
                if state == "open":
                    continue
                if r.ok:
                    bad, opened = 0, None
                else:
                    bad += 1
                    if bad >= failures or state == "half_open":
                        opened = r.at
            yield pd.DataFrame(out, columns=["provider", "event_id", "state"])

    calls = events.filter("provider is not null").select("provider", "event_id", "at", "ok")
    return calls.repartition("provider").sortWithinPartitions("provider", "at", "event_id").mapInPandas(run, BREAKER_SCHEMA)
