"""BM25 for batches of queries: by scoring records where they are, or over inverted postings.

``search`` sends the queries' terms to the records. One pass counts document frequencies and lengths, a second scores each
record against all queries by one product of its term weights with the queries' term counts and keeps the k best in each
task, so that neither postings nor scores of all pairs are exchanged. It needs the terms of a batch in memory; beyond
``QUERY_CELLS`` numbers, or with statistics of too many scopes, postings are joined instead: both ways use one tokeniser.
For a corpus that is searched again and again, ``index`` keeps postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import bm25_tokens, tokens_of
from corvane.runtime import importable

K1, B = 1.2, 0.75
#: A title's tokens count so many times, in frequencies and lengths.
TITLE_WEIGHT = 3
DIGITS = 6
#: Terms times queries (8 bytes each), and scopes times terms, that may be sent to every task.
QUERY_CELLS = 8_000_000
#: Hits that a task gathers before it keeps the best of them.
GATHERED = 500_000
#: Bytes of text whose terms a task holds at once; one longer record is taken alone.
TEXT_BYTES = 1_000_000

def tokenised(docs: DataFrame, unit: str, text: str, title: str | None = None, scope: Column | None = None) -> DataFrame:
    """(kb, id, tokens, dl): each record's tokens, the title's repeated by its weight. ``scope`` is what statistics are taken over."""
    tokens = bm25_tokens(F.col(text))
    if title:
        tokens = F.concat(F.flatten(F.array_repeat(bm25_tokens(F.col(title)), TITLE_WEIGHT)), tokens)
    return docs.select((scope if scope is not None else F.lit("all")).alias("kb"), F.col(unit).alias("id"), tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, qtf): a term that a query repeats counts again."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(bm25_tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def top(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "id", descending: bool = True) -> DataFrame:
    """The first k of each group by rounded score, ties by id; Spark limits each task's groups before the exchange."""
    order = F.desc(score) if descending else F.asc(score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).filter(F.col("rank") <= k)


def bm25(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, kb, id, score) of all records that hold a query's term.

    Lengths come from token arrays, so only tokens that some query asks for are exploded; frequencies, document
    frequencies and statistics are pre-aggregated.
    """
    stats = records.groupBy("kb").agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    asked = terms.select("term").distinct()
    postings = records.select("kb", "id", "dl", F.explode("tokens").alias("term")).join(asked, "term", "left_semi").groupBy("kb", "term", "id", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("kb", "term").agg(F.count("*").alias("df"))
    idf = df.join(stats, "kb").select("kb", "term", "avgdl", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return postings.join(idf, ["kb", "term"]).join(terms, "term").groupBy("query_id", "kb", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def id_column(df: DataFrame, name: str) -> Column:
    """An id as it is carried: whole numbers as longs, anything else as strings."""
    whole = df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col(name).cast("long" if whole else "string")


def query_bags(queries: DataFrame, query_id: str, text: str, most: int = QUERY_CELLS) -> Iterator[list[tuple[int | str, Counter]]]:
    """Blocks of (id, term counts), each of at most ``most`` terms times queries or of one query; rows of one id are one query, and a query needs an id."""
    rows = queries.select(id_column(queries, query_id).alias("q"), F.col(text).alias("t")).filter("q is not null").groupBy("q").agg(F.collect_list("t").alias("texts"))
    out: list[tuple[int | str, Counter]] = []
    known: set[str] = set()
    for r in rows.toLocalIterator():
        bag = Counter(t for text in r.texts for t in tokens_of(text))
        if out and (len(out) + 1) * len(known | bag.keys()) > most:
            yield out
            out, known = [], set()
        out.append((r.q, bag))
        known |= bag.keys()
    if out:
        yield out


def _records(docs: DataFrame, unit: str, text: str, title: str | None, scope: Column | None) -> DataFrame:
    return docs.select(id_column(docs, unit).alias("id"), (scope if scope is not None else F.lit("all")).cast("string").alias("kb"), F.col(text).alias("text"), (F.col(title) if title else F.lit("")).alias("title"))


def bags(records: DataFrame) -> DataFrame:
    """(dl, terms, tfs) of records (kb, text, title) in place of their texts, beside their other columns."""
    importable(records.sparkSession)
    rest = [f for f in records.schema.fields if f.name not in ("text", "title")]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            found = [(dl, list(bag), list(bag.values())) for _, bag, dl in _bags(batch)]
            new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], *new], names=[*[f.name for f in rest], "dl", "terms", "tfs"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    return records.mapInArrow(count, f"{kinds}, dl long, terms array<string>, tfs array<int>")


def postings(docs: DataFrame, unit: str, text: str, title: str | None = None, scope: Column | None = None) -> DataFrame:
    """(kb, id, dl, term, tf) of each record by itself, its terms counted a part of the text at a time."""
    rows = bags(_records(docs, unit, text, title, scope))
    return rows.select("kb", "id", "dl", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of ``TEXT_BYTES`` of text at most or of one record."""
    ends = np.cumsum(sum(np.asarray(pc.binary_length(batch.column(c)).fill_null(0), np.int64) for c in ("text", "title")))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXT_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _bags(batch: pa.RecordBatch) -> Iterator[tuple[str | None, Counter, int]]:
    """Scope, term counts and length of each record; a title counts ``TITLE_WEIGHT`` times."""
    for part in _parts(batch):
        for kb, text, title in zip(*(part.column(c).to_pylist() for c in ("kb", "text", "title")), strict=True):
            bag = Counter(tokens_of(text))
            for t in tokens_of(title):
                bag[t] += TITLE_WEIGHT
            yield kb, bag, sum(bag.values())


def search(docs: DataFrame, unit: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int, scope: Column | None = None, title: str | None = None, most: int = QUERY_CELLS, whole: bool = False) -> DataFrame:
    """The k best records of each query, and of each scope if one is named: query_id, kb, id, score, rank. A record without a scope is in none.

    Statistics are those of the scope, or with ``whole`` those of all scopes together. Ids are carried as ``id_column`` says.
    """
    keys = ("query_id",) if scope is None else ("query_id", "kb")
    docs = docs if scope is None else docs.filter(scope.isNotNull())
    importable(docs.sparkSession)
    blocks = query_bags(queries, query_id, query_text, most)
    asked = next(blocks, [])
    stats = None if next(blocks, None) or len(asked) * len({t for _, bag in asked for t in bag}) > most else _statistics(docs, unit, text, title, None if whole else scope, asked, most)
    if stats is None:
        named = docs.select("*", id_column(docs, unit).alias("__id"))
        terms = query_terms(queries.select(id_column(queries, query_id).alias("__query"), F.col(query_text).alias("__text")).filter("__query is not null"), "__query", "__text")
        found = bm25(tokenised(named, "__id", text, title, None if whole else scope), terms)
        if whole and scope is not None:
            found = found.drop("kb").join(named.select(F.col("__id").alias("id"), scope.alias("kb")), "id").select("query_id", "kb", "id", "score")
        return top(found, k, keys)
    kind = id_column(queries, query_id), id_column(docs, unit)
    query_kind, kind = (df.select(c).schema[0].dataType.simpleString() for df, c in zip((queries, docs), kind, strict=True))
    return top(_scored(_records(docs, unit, text, title, scope), asked, *stats, k, query_kind, kind), k, keys)


def _statistics(docs: DataFrame, unit: str, text: str, title: str | None, scope: Column | None, asked: list, most: int) -> tuple[dict, dict] | None:
    """Numbers of the asked terms, and for each scope its number of records, their mean length, and the terms' document frequencies."""
    number = {t: i for i, t in enumerate(sorted({t for _, bag in asked for t in bag}))}
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, found = shared.value, {}
        for batch in batches:
            for kb, bag, dl in _bags(batch):
                df = found.setdefault(kb, np.zeros(len(place) + 2, np.int64))
                df[[i for t in bag if (i := place.get(t)) is not None]] += 1
                df[-2:] += (1, dl)
        for kb, df in found.items():
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([kb] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["kb", "term", "c"])

    sums = _records(docs, unit, text, title, scope).mapInArrow(count, "kb string, term int, c long").groupBy("kb", "term").agg(F.sum("c").alias("c"))
    rows = sums.limit(most // 8 + 1).collect()  # at most a number for each asked term and scope
    if len(rows) > most // 8:
        return None
    out: dict = {}
    for r in rows:
        out.setdefault(r.kb, np.zeros(len(number) + 2, np.int64))[r.term] = r.c
    return number, {kb: (int(x[-2]), max(1.0, x[-1] / x[-2]), x[:-2]) for kb, x in out.items()}


def _scored(records: DataFrame, asked: list, number: dict, stats: dict, k: int, query_kind: str, kind: str) -> DataFrame:
    """(query_id, kb, id, score): the k best of each task."""
    ids = pa.array([q for q, _ in asked], pa.int64() if query_kind == "bigint" else pa.string())
    weights = np.zeros((len(number), len(asked)))
    for j, (_, bag) in enumerate(asked):
        for t, n in bag.items():
            weights[number[t], j] = n
    idf = {kb: (mean, np.log1p((n - df + 0.5) / (df + 0.5))) for kb, (n, mean, df) in stats.items()}
    shared = records.sparkSession.sparkContext.broadcast((number, ids, weights, idf))  # at most QUERY_CELLS numbers, and as many for the scopes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, weights, idf = shared.value
        scopes: dict[str, int] = {}
        names: list = []  # ids of records that a query met
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # group (scope and query), place of the id, score
        least = np.zeros(0)
        waiting, size = [best], 0

        def kept() -> list[np.ndarray]:
            group, doc, score = (np.concatenate(x) for x in zip(*waiting, strict=True))
            there, at = np.unique(doc, return_inverse=True)
            turn_of = np.empty(len(there), np.int64)
            turn_of[sorted(range(len(there)), key=lambda i: names[there[i]])] = np.arange(len(there))
            order = np.lexsort((turn_of[at], -score, group))
            group, doc, score = group[order], doc[order], score[order]
            turn = np.arange(len(group)) - np.searchsorted(group, group)
            last = turn == k - 1
            least[group[last]] = score[last]
            return [x[turn < k] for x in (group, doc, score)]

        for batch in batches:
            docs = batch.column("id").to_pylist()
            for row, (kb, bag, dl) in enumerate(_bags(batch)):
                hit = [(i, n) for t, n in bag.items() if (i := place.get(t)) is not None]
                if not hit or docs[row] is None:
                    continue
                mean, value = idf[kb] if kb in idf else idf["all"]
                at, tf = np.array(hit).T
                gain = value[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                score = gain @ weights[at]
                if kb not in scopes:
                    scopes[kb] = len(scopes)
                    least = np.concatenate([least, np.zeros(len(ids))])
                first = scopes[kb] * len(ids)
                some = np.flatnonzero(score > 0)
                rounded = np.round(score[some], DIGITS)
                fine = rounded >= least[first + some]
                names.append(docs[row])
                waiting.append([first + some[fine], np.full(int(fine.sum()), len(names) - 1), rounded[fine]])
                size += int(fine.sum())
                if size > GATHERED:
                    waiting, size = [kept()], 0
        group, doc, score = kept()
        shelves = np.array(list(scopes), object)
        for a in range(0, len(group), 100_000):
            part = slice(a, a + 100_000)
            found = pa.array([names[i] for i in doc[part]], pa.int64() if kind == "bigint" else pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(group[part] % len(ids))), pa.array(shelves[group[part] // len(ids)].tolist(), pa.string()), found, pa.array(score[part], pa.float64())], names=["query_id", "kb", "id", "score"])

    return records.mapInArrow(run, f"query_id {query_kind}, kb string, id {kind}, score double")
