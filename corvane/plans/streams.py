"""Streams driven to completion over the events table, as batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.plans.corpus import chunks_sql
from corvane.runtime import shared_folder, stable_name, table
from corvane.sources import chunks
from corvane.sources.versions import fingerprint
from corvane.streaming import jobs, manifest, quarantine

QUERIES, SQL = {}, {}


def _written(spark, stream, mode: str = "complete"):  # noqa: ANN001, ANN202
    """What a stream gives until its input ends: each batch is written to the shared folder by the executors, and the last one holds all in ``complete`` mode.

    The folder holds the stream's state as well, and goes with the driver.
    """
    base, paths = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", []

    def put(batch, number: int) -> None:  # noqa: ANN001
        path = f"{base}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        paths[:] = [path] if mode == "complete" else [*(x for x in paths if x != path), path]

    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def _events(spark, sf):  # noqa: ANN001, ANN202
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def str06_log_tail(spark, sf):  # noqa: ANN001, ANN201
    tail = _written(spark, jobs.log_tail(_events(spark, sf), "1 day"))
    return tail.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def str02_debounced_changes(spark, sf):  # noqa: ANN001, ANN201
    changes = _events(spark, sf).select(F.col("event_type").alias("kb"), F.col("user_id").alias("path"), "ts")
    return _written(spark, jobs.coalesced_changes(changes, "6 hours")).groupBy("kb", "path").agg(F.count("*").alias("bursts"), F.sum("events").alias("events"))


def str07_breaker(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("provider"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return jobs.breaker(e, failures=2, cooldown=7200.0)


def _attempts(events):  # noqa: ANN001, ANN202
    """Each user's events as a file's: signups stand for an operator's word, purchases for successes, all others for failures; content changes by the week."""
    kind = F.when(F.col("event_type") == "signup", "ack").when(F.col("event_type") == "purchase", "success").otherwise("failure")
    return events.select(F.col("user_id").cast("string").alias("path"), "ts", "event_id", kind.alias("kind"), F.weekofyear("ts").cast("string").alias("sha"))


def str04_quarantine(spark, sf):  # noqa: ANN001, ANN201
    """The stream of attempts replayed to its end: every decision, and every wait that ended within the log. A wait is an hour times a power of two here."""
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(store, quarantine.STORE)
    try:
        found = _written(spark, quarantine.decisions(_attempts(_events(spark, sf)), wait=3_600), "append")
    finally:
        spark.conf.set(store, before)
    return found.select("path", F.timestamp_millis("at").cast("timestamp_ntz").alias("decided_at"), "event_id", "decision", "tries")


def str03_snk01_manifest(spark, sf):  # noqa: ANN001, ANN201
    """Three batches of documents into the chunk store: without their last chunk, whole, and, where the language is French, with other words; then the first one again."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text", "lang")
    store = manifest.ChunkStore(spark, f"{shared_folder(spark)}/chunks-{stable_name(spark, sf, fingerprint(table(spark, sf, 'documents')))}")
    cut = lambda d: chunks.chunked(d.select("path", "text"))
    whole = cut(docs)
    last = F.max("chunk_index").over(Window.partitionBy("path"))
    short = whole.withColumn("last", last).filter((F.col("chunk_index") < F.col("last")) | (F.col("last") == 0)).drop("last")
    other = cut(docs.filter("lang = 'fr'").withColumn("text", F.concat(F.lit("Anew. "), "text")))
    for i, batch in enumerate((short, whole, other)):
        store.apply(batch, i)
    store.apply(short, 0)
    then = [store.versions.read("plan", v).select("path", F.col("action").alias(f"batch_{v}")) for v in (1, 2)]
    kept = store.read().groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))
    return kept.join(then[0], "path").join(then[1], "path", "left").select(F.col("path").alias("doc_id"), "n", "chars", "batch_1", "batch_2")


QUERIES |= {f.__name__: f for f in (str06_log_tail, str02_debounced_changes, str07_breaker, str04_quarantine, str03_snk01_manifest)}
_BOTH = "(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, 'Anew. ' || text FROM documents WHERE lang = 'fr')"
SQL |= {
    "str03_snk01_manifest": f"""WITH RECURSIVE {chunks_sql(_BOTH)}, k AS (SELECT doc_id, count(*) AS n, sum(length(chunk))::BIGINT AS chars FROM chunks WHERE chunk <> '' GROUP BY doc_id)
SELECT w.doc_id, coalesce(o.n, w.n) AS n, coalesce(o.chars, w.chars) AS chars, CASE WHEN w.n > 1 THEN 'append' ELSE 'same' END AS batch_1, CASE WHEN o.n IS NOT NULL THEN 'rebuild' END AS batch_2 FROM k w LEFT JOIN k o ON o.doc_id = -1 - w.doc_id WHERE w.doc_id >= 0""",
    "str06_log_tail": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "str07_breaker": """WITH RECURSIVE e AS (SELECT user_id % 50 AS provider, event_id, epoch(ts) AS sec, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
f(provider, n, event_id, state, bad, opened) AS (SELECT DISTINCT provider, 0::BIGINT, NULL::BIGINT, '', 0, NULL::DOUBLE FROM e UNION ALL
  SELECT provider, n, event_id, state, CASE WHEN state = 'open' THEN bad WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN state = 'open' THEN opened WHEN ok THEN NULL WHEN bad + 1 >= 2 OR state = 'half_open' THEN sec ELSE opened END
  FROM (SELECT e.provider, e.n, e.event_id, e.sec, e.ok, f.bad, f.opened, CASE WHEN f.opened IS NULL THEN 'closed' WHEN e.sec - f.opened < 7200 THEN 'open' ELSE 'half_open' END AS state FROM f JOIN e ON e.provider = f.provider AND e.n = f.n + 1))
SELECT provider, event_id, state FROM f WHERE n > 0""",
    "str04_quarantine": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS path, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'signup' THEN 'ack' WHEN 'purchase' THEN 'success' ELSE 'failure' END AS kind, weekofyear(ts) AS sha, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
f(path, n, ms, event_id, decision, was, tries, due, ack, sha) AS (SELECT DISTINCT path, 0::BIGINT, 0::BIGINT, NULL::BIGINT, '', 0, 0, NULL::BIGINT, false, NULL::BIGINT FROM e UNION ALL
  SELECT path, n, ms, event_id, decision, tries, CASE WHEN kind = 'ack' OR decision IN ('dead_lettered', 'backoff_active') THEN tries WHEN kind = 'success' THEN 0 WHEN decision IN ('no_record', 'content_changed') THEN 1 ELSE tries + 1 END AS now,
    CASE WHEN kind = 'ack' THEN 0 WHEN decision IN ('dead_lettered', 'backoff_active') THEN due WHEN kind = 'success' THEN NULL ELSE ms + 1000 * least(86400, 3600 * 2 ** CASE WHEN decision IN ('no_record', 'content_changed') THEN 1 ELSE tries + 1 END)::BIGINT END,
    CASE WHEN kind = 'ack' THEN tries > 0 WHEN decision IN ('dead_lettered', 'backoff_active') THEN ack ELSE false END, CASE WHEN kind = 'ack' OR decision IN ('dead_lettered', 'backoff_active') THEN old ELSE sha END
  FROM (SELECT e.*, f.tries, f.due, f.ack, f.sha AS old, CASE WHEN kind = 'ack' THEN CASE WHEN f.tries > 0 THEN 'ack' ELSE 'nothing_to_ack' END WHEN f.tries = 0 THEN 'no_record' WHEN f.sha <> e.sha THEN 'content_changed' WHEN f.ack THEN 'forced_ack'
    WHEN f.tries >= 5 THEN 'dead_lettered' WHEN f.due > e.ms THEN 'backoff_active' ELSE 'backoff_elapsed' END AS decision FROM f JOIN e ON e.path = f.path AND e.n = f.n + 1))
SELECT path, epoch_ms(ms)::TIMESTAMP AS decided_at, event_id, decision, tries FROM f WHERE n > 0
UNION ALL SELECT path, epoch_ms(due)::TIMESTAMP, NULL, 'due', tries FROM (SELECT f.path, f.tries, f.due, f.ack, f.decision, lead(f.ms, 1, (SELECT max(ms) FROM e)) OVER (PARTITION BY f.path ORDER BY f.n) AS until FROM f WHERE f.n > 0)
  WHERE tries BETWEEN 1 AND 4 AND NOT ack AND due <= until""",
    "str02_debounced_changes": "WITH g AS (SELECT event_type AS kb, user_id AS path, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events) SELECT kb, path, sum(first)::BIGINT AS bursts, count(*) AS events FROM g GROUP BY ALL",
}
