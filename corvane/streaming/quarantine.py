"""Quarantine of files that failed to ingest, as state of a stream.

A file that fails waits twice as long after every try, up to a day, and is a dead letter after ``TRIES`` of them. Other content, or an
operator's word, lets it be tried at once; a success ends its quarantine. The state of a file is one small record; a timer tells when its
wait is over. Files don't share records and are dealt to groups by their path, so any number of them is spread over the executors; a group
has one timer, for the wait that ends first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.runtime import importable

# Tries before a file is a dead letter, the unit of its wait and the longest wait in seconds, files listed of a shelf.
TRIES, WAIT, LONGEST, LISTED = 5, 60, 86_400, 1_000
#: Groups that files are dealt to: the records of one are kept, read and written together.
GROUPS = 2_048
FIELDS = ("sha", "tries", "next", "ack", "told", "last")
STATE = "records array<struct<path: string, sha: string, tries: int, next: long, ack: boolean, told: boolean, last: long>>"
DECISIONS = "path string, at long, event_id long, decision string, tries int, next long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Quarantine:
    """Decides on the attempts and words of the files of one group, each in order of time; times are milliseconds."""

    def __init__(self, tries: int = TRIES, wait: int = WAIT, longest: int = LONGEST):
        self.most, self.wait, self.longest = tries, wait, longest

    def decide(self, record: dict | None, at: int, sha: str) -> str:
        if record is None:
            return "no_record"
        if record["sha"] != sha:
            return "content_changed"
        if record["ack"]:
            return "forced_ack"
        if record["tries"] >= self.most:
            return "dead_lettered"
        return "backoff_active" if record["next"] > at else "backoff_elapsed"

    def waits(self, record: dict | None) -> bool:
        return record is not None and not record["ack"] and not record["told"] and record["tries"] < self.most

    def step(self, record: dict | None, at: int, kind: str, sha: str) -> tuple[dict | None, str]:
        """The record after an event, and what was decided."""
        if kind == "ack":
            return ({**record, "ack": True, "next": 0}, "ack") if record else (None, "nothing_to_ack")
        decision = self.decide(record, at, sha)
        if decision in ("dead_lettered", "backoff_active"):
            return record, decision
        if kind == "success":
            return None, decision
        tries = 1 if decision in ("no_record", "content_changed") else record["tries"] + 1
        wait = min(self.longest, 2**tries * self.wait) * 1000
        return {"sha": sha, "tries": tries, "next": at + wait, "ack": False, "told": False, "last": at}, decision

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A group's events of a batch, or the end of a wait; calls cost more than rows, so that one is made for many files."""
        records = {r[0]: dict(zip(FIELDS, r[1:], strict=True)) for r in state.get[0]} if state.exists else {}
        out = []

        def due(path: str, by: int) -> None:
            record = records.get(path)
            if self.waits(record) and record["next"] <= by:
                out.append((path, record["next"], None, "due", record["tries"], record["next"]))
                records[path] = {**record, "told": True}

        events = [] if state.hasTimedOut else [e for f in frames for e in zip(*(f[c].tolist() for c in ("at", "event_id", "path", "kind", "sha")), strict=True)]
        for at, event_id, path, kind, sha in sorted(events, key=lambda e: (e[0], pd.isna(e[1]), e[1])):
            due(path, at)
            record, decision = self.step(records.pop(path, None), at, kind, sha)
            if record is not None:
                records[path] = record
            out.append((path, at, event_id, decision, record["tries"] if record else 0, record["next"] if record else None))
        for path in list(records):
            due(path, state.getCurrentWatermarkMs())
        if records:
            state.update(([(path, *r.values()) for path, r in records.items()],))
            waits = [r["next"] for r in records.values() if self.waits(r)]
            if waits:
                # a timeout ends when the watermark is beyond it, a wait when it is reached
                state.setTimeoutTimestamp(max(min(waits) - 1, 1))
        elif state.exists:
            state.remove()
        if out:
            yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ("path", "at", "event_id", "decision", "tries", "next")
    kinds = (object, "int64", "Int64", object, "int32", "Int64")
    return pd.DataFrame({n: pd.array(c, k) if k == "Int64" else np.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})


def decisions(events: DataFrame, tries: int = TRIES, wait: int = WAIT, longest: int = LONGEST, late: str = "0 seconds") -> DataFrame:
    """From a stream of events (path, ts, event_id, kind: failure, success or ack, sha), a row for each decision and for each wait that ends.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` set to ``STORE``.
    """
    importable(events.sparkSession)
    rows = events.withWatermark("ts", late).select(F.pmod(F.xxhash64("path"), F.lit(GROUPS)).alias("group"), "path", "ts", F.unix_millis("ts").alias("at"), "event_id", "kind", "sha")
    return rows.groupBy("group").applyInPandasWithState(Quarantine(tries, wait, longest), DECISIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def listing(decided: DataFrame, shelf: str, most: int = LISTED) -> DataFrame:
    """Files in quarantine after these decisions (path, at, event_id, tries, next, and ``shelf``): of each shelf the ``most`` that were tried last."""
    last = Window.partitionBy(shelf, "path").orderBy(F.desc("at"), F.desc_nulls_last("event_id"))
    now = decided.filter(F.col("decision") != "due").withColumn("turn", F.row_number().over(last)).filter((F.col("turn") == 1) & (F.col("tries") > 0))
    return now.withColumn("turn", F.row_number().over(Window.partitionBy(shelf).orderBy(F.desc("at"), "path"))).filter(F.col("turn") <= most).drop("turn")
