"""A lexical index that is kept: inverted postings, written once, refreshed by what changed, read for asked terms only.

Records are dealt to shards by their id. Each shard's postings are inverted where it is, so that a row holds one term's
records of one shard (and scope), with frequencies and lengths. Rows are stored by hash of their term in buckets, sorted by term, so
a batch of queries reads the files of its terms alone. A shard is scored in one place and gives on each query's best; postings of a
document are never exchanged one by one.

A refresh compares the records' hashes with those kept. New and changed records are written as a version of their own,
and what they replace, or what went, is listed as gone from the version that holds it; nothing else is written. Beyond
``MOST_VERSIONS`` of them the index is built anew. The pointer moves last (see ``versions``).

Statistics are those of all records, or of a record's scope, as they stand at the time of the search. Ids may be of any type that can be
ordered; they name records, so they must not repeat. Rows without an id are left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lexical import DIGITS, K1, QUERY_CELLS, B, bags, id_column, query_bags, top
from corvane.runtime import importable, shared_folder, stable_name
from corvane.sources.versions import Versions, fingerprint

#: Characters of text for a shard: small ones as long as there are few, so that a small index is searched in parallel.
SMALL_SHARD, SHARD, MANY_SHARDS = 4_000_000, 64_000_000, 4_096
#: Characters of text for a bucket of terms.
BUCKET, LEAST_BUCKETS = 1_000_000_000, 16
MOST_VERSIONS = 8
#: Terms that are pushed to the files one by one. More are broadcast, bounded by ``QUERY_CELLS``.
FEW_TERMS = 64
#: Numbers that a shard holds at once while it scores.
CELLS = 4_000_000


def _invert(table: pa.Table) -> pa.Table:
    """Rows (shard, kb, term, ids, tfs, dls) of a shard's bags."""
    table = table.combine_chunks()
    column = lambda c: table.column(c).chunk(0) if table.num_rows else table.column(c).combine_chunks()
    terms, sizes = column("terms"), np.asarray(pc.list_value_length(column("terms")))
    doc = np.repeat(np.arange(len(table)), sizes)
    words = terms.flatten().dictionary_encode()
    scopes = column("kb").dictionary_encode()
    scope = np.asarray(scopes.indices.fill_null(len(scopes.dictionary)))[doc]
    key = scope.astype(np.int64) * (len(words.dictionary) + 1) + np.asarray(words.indices)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    first, offsets = order[starts], pa.array(np.r_[starts, len(order)], pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    at = pa.array(doc[order])
    return pa.table({
        "shard": pa.array(np.full(len(starts), table.column("shard")[0].as_py() if len(table) else 0), pa.int32()),
        "kb": column("kb").take(pa.array(doc[first])), "term": terms.flatten().take(pa.array(first)),
        "ids": lists(column("id").take(at)), "tfs": lists(column("tfs").flatten().take(pa.array(order))), "dls": lists(column("dl").take(at)),
    })


def _without(postings: pa.Table, gone: pa.Table) -> pa.Table:
    """A shard's postings without the records that are gone from the version that holds them."""
    if not gone.num_rows or not postings.num_rows:
        return postings
    out = []
    for version in pc.unique(postings.column("version")).to_pylist():
        rows = postings.filter(pc.equal(postings.column("version"), version)).combine_chunks()
        ids = rows.column("ids").combine_chunks()
        live = pc.invert(pc.is_in(ids.flatten(), gone.filter(pc.equal(gone.column("version"), version)).column("id").combine_chunks()))
        kept = np.add.reduceat(np.r_[np.asarray(live, np.int64), 0], np.r_[0, np.cumsum(np.asarray(pc.list_value_length(ids)))][:-1])
        offsets = pa.array(np.r_[0, np.cumsum(kept)], pa.int32())
        for c in ("ids", "tfs", "dls"):
            rows = rows.set_column(rows.schema.get_field_index(c), c, pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks().flatten().filter(live)))
        out.append(rows.filter(pa.array(kept > 0)))
    return pa.concat_tables(out)


class LexicalIndex:
    """The index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        importable(spark)
        self.spark, self.versions = spark, Versions(spark, path)

    # --- writing ------------------------------------------------------------------------------------------------------

    def refresh(self, docs: DataFrame, unit: str, text: str, scope: Column | None = None, title: str | None = None, source: str = "") -> dict:
        """Let the index hold ``docs``; how many records were added, changed and removed. ``source`` is what the pointer says about them."""
        fields = [id_column(docs, unit).alias("id"), (scope if scope is not None else F.lit("all")).cast("string").alias("kb"), F.col(text).alias("text"), (F.col(title) if title else F.lit("")).alias("title")]
        records = docs.select(*fields).filter(F.col("id").isNotNull())
        parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in ("kb", "title", "text")]
        records = records.withColumn("sha", F.sha2(F.concat(*parts), 256))
        state = self.versions.state()
        version = state["version"] + 1 if state else 0
        if state is None or len(state["live"]) >= MOST_VERSIONS:
            chars = records.agg(F.sum(F.length("text"))).first()[0] or 0
            shards = max(1, -(-chars // SHARD), min(MANY_SHARDS, -(-chars // SMALL_SHARD)))
            self._write(records, version, shards, max(LEAST_BUCKETS, -(-chars // BUCKET)))
            n = self.versions.read("records", version).count()
            self.versions.move(version, live=[version], gone=[], shards=shards, buckets=max(LEAST_BUCKETS, -(-chars // BUCKET)), source=source)
            return {"added": n, "changed": 0, "removed": 0}
        now = records.select("id", F.col("sha").alias("new"))
        diff = self.records(state).select("id", "sha", "kb", "dl", "shard", F.col("version").alias("of")).join(now, "id", "full_outer").filter(~F.col("sha").eqNullSafe(F.col("new")))
        self.versions.write(diff, "diff", version)
        diff = self.versions.read("diff", version).drop("version")
        told = diff.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in (("added", F.col("sha").isNull()), ("changed", F.col("sha") != F.col("new")), ("removed", F.col("new").isNull()))]).first().asDict()
        if not any(told.values()):
            self.versions.move(version, **{k: v for k, v in state.items() if k not in ("version", "source")}, source=source)
            return told
        fresh = records.join(diff.filter(F.col("new").isNotNull()).select("id"), "id", "left_semi")
        gone = diff.filter(F.col("sha").isNotNull())
        self._write(fresh, version, state["shards"], state["buckets"])
        self.versions.write(gone.select("id", "shard", "of", "kb", "dl"), "gone", version)
        self.versions.move(version, live=[*state["live"], version], gone=[*state["gone"], version], shards=state["shards"], buckets=state["buckets"], source=source)
        return told

    def _write(self, records: DataFrame, version: int, shards: int, buckets: int) -> None:
        shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
        counted = bags(records.select("id", "kb", "text", "title", "sha")).withColumn("shard", shard)
        self.versions.write(counted, "bags", version)
        counted = self.versions.read("bags", version).drop("version")
        self.versions.write(counted.select("id", "kb", "sha", "dl", "shard"), "records", version)
        self.versions.write(counted.groupBy("kb").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")), "totals", version)
        kind = counted.schema["id"].dataType.simpleString()
        rows = counted.select("shard", "id", "kb", "dl", "terms", "tfs").groupBy("shard").applyInArrow(_invert, f"shard int, kb string, term string, ids array<{kind}>, tfs array<int>, dls array<long>")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        self.versions.write(rows.repartitionByRange(shards, "bucket", "term", "shard").sortWithinPartitions("bucket", "term"), "postings", version, "bucket")

    # --- reading ------------------------------------------------------------------------------------------------------

    def _gone(self, state: dict) -> DataFrame:
        return self.versions.read("gone", *state["gone"]).drop("version").withColumnRenamed("of", "version")

    def records(self, state: dict | None = None) -> DataFrame:
        """(id, kb, sha, dl, shard, version) of what the index holds."""
        state = state or self.versions.state()
        rows = self.versions.read("records", *state["live"])
        return rows.join(self._gone(state).select("id", "version"), ["id", "version"], "left_anti") if state["gone"] else rows

    def totals(self, state: dict | None = None) -> DataFrame:
        """(kb, n, dl): how many records each scope has, and the sum of their lengths."""
        state = state or self.versions.state()
        rows = self.versions.read("totals", *state["live"]).select("kb", "n", "dl")
        if state["gone"]:
            rows = rows.unionByName(self._gone(state).select("kb", F.lit(-1).cast("long").alias("n"), (-F.col("dl")).alias("dl")))
        return rows.groupBy("kb").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).filter("n > 0")

    def postings(self, terms: list[str], state: dict | None = None) -> DataFrame:
        """(shard, kb, term, ids, tfs, dls) of some terms; files of other buckets are not opened."""
        state = state or self.versions.state()
        asked = self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
        numbers = {r.b for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(state["buckets"])).cast("int").alias("b")).collect()}
        rows = self.versions.read("postings", *state["live"]).filter(F.col("bucket").isin(*sorted(numbers)))
        # few terms reach the files' own statistics; many are sent to the rows instead, as a list of them is slow to plan
        rows = rows.filter(F.col("term").isin(terms)) if len(terms) <= FEW_TERMS else rows.join(F.broadcast(asked), "term", "left_semi")
        rows = rows.select("version", "shard", "kb", "term", "ids", "tfs", "dls")
        if state["gone"]:
            gone = self._gone(state).select("version", "shard", "id")
            rows = rows.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_without, rows.schema)
        return rows.drop("version")

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int, per_scope: bool = False, whole: bool = False, most: int = QUERY_CELLS) -> DataFrame:
        """The k best records of each query, and of each scope with ``per_scope``: query_id, kb, id, score, rank. A record without a scope is in none.

        Statistics are the scope's own with ``per_scope``, unless ``whole``. Queries are taken in blocks of at most ``most`` numbers.
        """
        state, found = self.versions.state(), None
        kind = queries.select(id_column(queries, query_id)).schema[0].dataType.simpleString()
        for asked in query_bags(queries, query_id, query_text, most):
            part = self._search(asked, kind, k, per_scope, whole, state)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self._search([], kind, k, per_scope, whole, state).withColumn("rank", F.lit(0))
        return top(found, k, ("query_id", "kb") if per_scope else ("query_id",))

    def _search(self, asked: list[tuple[object, Counter]], query_kind: str, k: int, per_scope: bool, whole: bool, state: dict) -> DataFrame:
        terms = sorted({t for _, bag in asked for t in bag})
        number = {t: i for i, t in enumerate(terms)}
        postings = self.postings(terms, state)
        if per_scope:
            postings = postings.filter(F.col("kb").isNotNull())
        by = ["kb"] if per_scope and not whole else []
        total = self.totals(state).filter(F.col("kb").isNotNull() if per_scope else F.lit(True)).groupBy(*by).agg(F.sum("n").alias("n"), F.greatest(F.sum("dl") / F.sum("n"), F.lit(1.0)).alias("mean"))
        counts = postings.groupBy(*by, "term").agg(F.sum(F.size("ids")).alias("df"))
        told = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))  # one row
        told = told.select(*by, "term", "mean", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        lines = np.array(sorted((number[t], j, n) for j, (_, bag) in enumerate(asked) for t, n in bag.items()), np.int64).reshape(-1, 3)  # term, query, times
        at = np.searchsorted(lines[:, 0], np.arange(len(terms) + 1))
        shared = self.spark.sparkContext.broadcast((number, at, lines[:, 1].copy(), lines[:, 2].astype(np.float64)))  # bounded by a block of queries
        names = pa.array([q for q, _ in asked], pa.int64() if query_kind == "bigint" else pa.string())
        kind = postings.schema["ids"].dataType.elementType.simpleString()

        def score(table: pa.Table) -> pa.Table:
            place, at, who, times = shared.value
            ids = table.column("ids").combine_chunks()
            sizes = np.asarray(pc.list_value_length(ids))
            flat = ids.flatten()
            known = pc.unique(flat)
            known = known.take(pc.array_sort_indices(known))
            doc = np.asarray(pc.index_in(flat, known))
            scopes = table.column("kb").combine_chunks().dictionary_encode()
            kb_of = np.zeros(len(known), np.int64)
            kb_of[doc] = np.repeat(np.asarray(scopes.indices.fill_null(-1)), sizes)
            tf, dl = (np.asarray(table.column(c).combine_chunks().flatten(), np.float64) for c in ("tfs", "dls"))
            idf, mean = (np.repeat(np.asarray(table.column(c)), sizes) for c in ("idf", "mean"))
            gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            # all of a term's postings next to each other, whatever their scopes and versions
            term = np.repeat(np.array([place[t] for t in table.column("term").to_pylist()], np.int64), sizes)
            order = np.argsort(term, kind="stable")
            doc, gain, term = doc[order], gain[order], term[order]
            there, starts = np.unique(term, return_index=True)
            spans = list(zip(there.tolist(), starts.tolist(), [*starts.tolist()[1:], len(term)], strict=True))
            group = kb_of if per_scope else np.zeros(len(known), np.int64)
            step, out = max(1, CELLS // len(known)), []
            for low in range(0, len(names), step):
                sums = np.zeros((min(step, len(names) - low), len(known)))
                for t, begin, end in spans:
                    a, z = at[t] + np.searchsorted(who[at[t] : at[t + 1]], [low, low + step])
                    ids_, gains = doc[begin:end], gain[begin:end]
                    for j, n in zip((who[a:z] - low).tolist(), times[a:z].tolist(), strict=True):
                        sums[j, ids_] += n * gains
                for j, line in enumerate(sums):
                    hit = np.flatnonzero(line > 0)
                    rounded = np.round(line[hit], DIGITS)
                    if not per_scope and len(hit) > 4 * k:
                        best = rounded >= np.partition(rounded, len(hit) - k)[len(hit) - k]
                        hit, rounded = hit[best], rounded[best]
                    order = np.lexsort((hit, -rounded, group[hit]))
                    hit, rounded = hit[order], rounded[order]
                    turn = np.arange(len(hit)) - np.searchsorted(group[hit], group[hit])
                    out.append((np.full((turn < k).sum(), low + j), hit[turn < k], rounded[turn < k]))
            q, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
            kb = pc.take(scopes.dictionary, pa.array(kb_of[d], mask=kb_of[d] < 0))
            return pa.table({"query_id": names.take(pa.array(q)), "kb": kb, "id": known.take(pa.array(d)), "score": pa.array(s)})

        scored = postings.join(told, [*by, "term"]).groupBy("shard").applyInArrow(score, f"query_id {query_kind}, kb string, id {kind}, score double")
        return scored if per_scope else scored.withColumn("kb", F.lit("all"))

    def search_scopes(self, queries: DataFrame, query_id: str, query_text: str, k: int, most: int = QUERY_CELLS) -> DataFrame:
        """The k best scopes of each query, each taken as one record of all its texts, with its best record by the records' own ranking: query_id, kb, score, rank, best."""
        state, found = self.versions.state(), None
        total = self.totals(state).filter(F.col("kb").isNotNull())
        whole = total.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("mean"))  # one row
        kind = queries.select(id_column(queries, query_id)).schema[0].dataType.simpleString()
        for asked in query_bags(queries, query_id, query_text, most):
            rows = [(q, t, n) for q, bag in asked for t, n in bag.items()]
            terms = self.spark.createDataFrame(rows, f"query_id {kind}, term string, qtf long")
            tf = F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tf")
            hit = self.postings(sorted({t for _, t, _ in rows}), state).filter(F.col("kb").isNotNull()).groupBy("kb", "term").agg(tf)
            idf = hit.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))
            part = F.col("qtf") * F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
            scored = hit.join(idf, "term").join(total.select("kb", "dl"), "kb").join(terms, "term").groupBy("query_id", "kb").agg(F.round(F.sum(part), DIGITS).alias("score"))
            found = scored if found is None else found.unionByName(scored)
        best = self.search(queries, query_id, query_text, 1, per_scope=True, whole=True, most=most).select("query_id", "kb", F.col("id").alias("best"))
        if found is None:
            return best.select("query_id", "kb", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), "best")
        return top(found, k, tie="kb").join(best, ["query_id", "kb"])


def index_of(spark: SparkSession, sf_dir: str, table: str, unit: str, text: str, scope: str | None = None, title: str | None = None) -> LexicalIndex:
    """The index of a table of files, kept in the shared folder: built where there is none, refreshed where the files have changed since."""
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    index = LexicalIndex(spark, f"{shared_folder(spark)}/lexical-{stable_name(spark, sf_dir, table, unit, text, scope or '', title or '')}")
    files, state = fingerprint(source), index.versions.state()
    if state is None or state["source"] != files:
        index.refresh(source, unit, text, F.col(scope) if scope else None, title, files)
    return index
