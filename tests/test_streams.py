"""Streams that are run to their end: what they give stands in files, not in the driver."""

import pytest

from corvane.plans import streams
from corvane.runtime import table
from corvane.streaming import quarantine
from test_state import EVENTS, START, attempts, by_hand


def agrees(frame, name, sf):
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    return sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(frame.columns)} FROM ({streams.SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", ["str02_debounced_changes", "str06_log_tail"])
def test_results_are_read_from_files_and_agree_with_sql(spark, sf, name):
    frame = streams.QUERIES[name](spark, sf)
    assert frame.inputFiles()
    assert agrees(frame, name, sf)


def test_a_stream_without_rows_gives_none(spark, sf, tmp_path):
    table(spark, sf, "events").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert streams.str02_debounced_changes(spark, str(tmp_path)).count() == 0


def test_files_of_a_group_are_judged_together_and_each_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quarantine, "GROUPS", 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", quarantine.STORE)
    rows, base = attempts(5), int(START.timestamp() * 1000)
    for part in (rows[:250], rows[250:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        log = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        run = quarantine.decisions(log).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(300)
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 < len({r[0] for r in rows})
    found = spark.read.schema(quarantine.DECISIONS).parquet(f"{tmp_path}/out").collect()
    assert sorted(str((r.path, r.at - base, r.event_id, r.decision, r.tries)) for r in found) == by_hand(rows)


def test_quarantine_agrees_with_sql(spark, sf):
    assert agrees(streams.str04_quarantine(spark, sf), "str04_quarantine", sf)
