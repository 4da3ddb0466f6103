"""Quarantine as state of a stream, and the chunk store: restarts, repeats and crashes change nothing."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from corvane.sources.versions import Versions
from corvane.streaming import manifest, quarantine

START = datetime(2024, 1, 1, tzinfo=UTC)
EVENTS = "path string, ts timestamp, event_id long, kind string, sha string"


def attempts(seed, n=400):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([1, 30, 90, 600, 4_000])
        kind = rng.choices(["failure", "success", "ack"], [8, 1, 1])[0]
        out.append((f"f{rng.randint(0, 5)}", START + timedelta(seconds=at), i, kind, f"v{at // 60_000}"))
    return out


def by_hand(rows, tries=5, wait=60):
    state, out, end = {}, [], max(r[1] for r in rows)
    ms = lambda t: int((t - START).total_seconds() * 1000)
    waiting = lambda r: r and not r["ack"] and r["n"] < tries
    for path, ts, i, kind, sha in rows:
        r, now = state.get(path), ms(ts)
        if waiting(r) and not r["told"] and r["next"] <= now:
            out.append((path, r["next"], None, "due", r["n"]))
            r["told"] = True
        if kind == "ack":
            if r:
                r.update(ack=True, next=0)
            out.append((path, now, i, "ack" if r else "nothing_to_ack", r["n"] if r else 0))
            continue
        if not r:
            d = "no_record"
        elif r["sha"] != sha:
            d = "content_changed"
        elif r["ack"]:
            d = "forced_ack"
        elif r["n"] >= tries:
            d = "dead_lettered"
        else:
            d = "backoff_active" if r["next"] > now else "backoff_elapsed"
        if d not in ("dead_lettered", "backoff_active"):
            if kind == "success":
                state.pop(path, None)
            else:
                n = r["n"] + 1 if r and d != "content_changed" else 1
                state[path] = {"n": n, "sha": sha, "next": now + 1000 * min(86_400, 2**n * wait), "ack": False, "told": False}
        out.append((path, now, i, d, state.get(path, {"n": 0})["n"]))
    out += [(p, r["next"], None, "due", r["n"]) for p, r in state.items() if waiting(r) and not r["told"] and r["next"] <= ms(end)]
    return sorted(map(str, out))


def test_quarantine_survives_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", quarantine.STORE)
    rows = attempts(3)
    want = by_hand(rows)
    assert {d for d in ("no_record", "content_changed", "forced_ack", "dead_lettered", "backoff_active", "backoff_elapsed", "ack", "nothing_to_ack", "due") if any(f"'{d}'" in r for r in want)} >= {"no_record", "content_changed", "forced_ack", "dead_lettered", "backoff_active", "backoff_elapsed", "due"}
    put = lambda part, name: spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run(name):
        log = spark.readStream.schema(EVENTS).parquet(str(tmp_path / name))
        query = quarantine.decisions(log).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        base = int(START.timestamp() * 1000)
        return sorted(str((r.path, r.at - base, r.event_id, r.decision, r.tries)) for r in spark.read.schema(quarantine.DECISIONS).parquet(str(tmp_path / f"{name}-out")).collect())

    put(rows, "whole")
    assert run("whole") == want
    put(rows[:150], "parts")
    first = run("parts")
    assert run("parts") == first and set(first) < set(want)
    put(rows[150:], "parts")
    assert run("parts") == want == run("parts")


def test_the_files_listed_of_a_shelf_are_those_tried_last(spark):
    rows = [("s", f"p{i}", i, i, "no_record", 1, 0) for i in range(9)] + [("s", "p3", 50, 60, "backoff_elapsed", 0, 0), ("s", "p8", 70, None, "due", 1, 0), ("t", "p8", 1, 1, "no_record", 1, 0)]
    df = spark.createDataFrame(rows, "shelf string, path string, at long, event_id long, decision string, tries int, next long")
    assert sorted((r.shelf, r.path) for r in quarantine.listing(df, "shelf", 3).collect()) == [("s", "p6"), ("s", "p7"), ("s", "p8"), ("t", "p8")]


def batch(spark, **files):
    rows = [(p, i, c) for p, body in files.items() for i, c in enumerate(body.split())] + [(p, None, None) for p, body in files.items() if not body]
    return spark.createDataFrame(rows, "path string, chunk_index int, chunk string")


def held(store):
    out = {}
    for r in store.read().orderBy("path", "chunk_index").collect():
        out.setdefault(r.path, []).append(r.chunk)
    return {p: " ".join(c) for p, c in out.items()}


def test_batches_append_rebuild_and_repeat(spark, tmp_path, monkeypatch):
    store = manifest.ChunkStore(spark, str(tmp_path / "s"))
    assert store.apply(batch(spark, a="x y", b="p q r"), 0) == {"add": 2}
    assert store.apply(batch(spark, a="x y z", c="m", b="p q r"), 1) == {"append": 1, "add": 1, "same": 1}
    assert held(store) == {"a": "x y z", "b": "p q r", "c": "m"} and store.versions.state()["live"] == [0, 1]
    assert spark.read.parquet(str(tmp_path / "s/chunks/version=1")).count() == 2  # only z and m
    assert store.apply(batch(spark, a="x y z", c="m", b="p q r"), 1) == {} and store.apply(batch(spark, a="old"), 0) == {}
    before = held(store)

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versions, "move", crash)
        with pytest.raises(RuntimeError, match="lost"):
            store.apply(batch(spark, a="x Y", b="p q r s"), 2)
    assert held(store) == before  # the data stands, the pointer doesn't
    assert store.apply(batch(spark, a="x Y", b="p q r s"), 2) == {"rebuild": 1, "append": 1}
    assert held(store) == {"a": "x Y", "b": "p q r s", "c": "m"} and store.versions.state()["live"] == [2]
    assert store.apply(batch(spark, b="p q r s", c=""), 3) == {"same": 1, "rebuild": 1}
    assert held(store) == {"a": "x Y", "b": "p q r s"}
    assert store.apply(batch(spark, a="x Y"), 4) == {"same": 1} and [s["version"] for s in store.versions.states()] == [0, 1, 2, 3, 4]


def test_a_stream_feeds_the_store_once(spark, tmp_path):
    store = manifest.ChunkStore(spark, str(tmp_path / "s"))
    source = tmp_path / "in"
    for i, files in enumerate(({"a": "x"}, {"a": "x y", "b": "q"})):
        batch(spark, **files).coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(2):
            rows = spark.readStream.schema("path string, chunk_index int, chunk string").parquet(str(source))
            rows.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        assert store.versions.state()["batch"] == i
    assert held(store) == {"a": "x y", "b": "q"}
