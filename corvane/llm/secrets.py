"""Secret scans by corpus-wide ownership frequency.

Mappers find candidate spans in whole texts: three base kinds that are always reported, and generic tokens that look
like credentials. The hash of each candidate's value is then counted over the corpus by distinct owners, and by distinct
repositories where the caller names their column. Values spread over many owners are copied examples; values that one
owner or two hold, in few repositories if these are known, look live. A generic token becomes a span only if it looks
live; base spans stay whatever their class.

``source`` is the owner. The corpus has no column for repositories, so owners alone decide, however many documents repeat a value.

Defined results: null and empty texts have no spans; texts of any length are scanned whole. Null owners count as one owner
of their own. Repeated rows repeat their results and add no owner. Spans of equal starts are ordered by kind. Offsets are
code points, ends exclusive. Extra columns pass through, but for those named ``secrets``, ``__found`` or ``__row``, which are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, read

# Patterns of the three base kinds, in their listed order, with the least length of what counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "generic")
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
#: Runs of 20 and 24 characters at least; the same as dropping shorter matches of the open-ended patterns.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A generic candidate: a long run with digits, lower-case and upper-case letters.
_GENERIC = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")

#: A value that more owners hold, or more repositories where these are known, is a copied example.
LIVE_OWNERS = 2
LIVE_REPOSITORIES = 12

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.LongType())])
SPANS = T.ArrayType(SPAN)
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all candidates, in order; generic ones only where no base span lies."""
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for s, _, e, _ in found)
    i = 0
    for m in _GENERIC.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if (i == len(taken) or taken[i][0] >= m.end()) and _MIXED.match(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__found``: the candidate spans of each row, with a hash of each value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": s, "kind": k, "end": e, "value": _hash(v)} for s, k, e, v in find(t.as_py())] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW_SPANS)], names=[*batch.schema.names, "__found"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__found", SPANS)]))


def ownership(found: DataFrame, owner: str, repository: str | None = None) -> DataFrame:
    """For each candidate hash: ``n_owners``, ``n_repositories`` (with a column of them) and ``live``. Counts are pre-aggregated, so a value in many rows is no hot key."""
    spans = found.select(F.explode("__found.value").alias("value"), F.coalesce(F.col(owner).cast("string"), F.lit("\x00null")).alias("owner"), *([F.col(repository).alias("repository")] if repository else []))
    if not repository:
        return spans.distinct().groupBy("value").agg(F.count("*").alias("n_owners")).withColumn("live", F.col("n_owners") <= LIVE_OWNERS)
    pairs = spans.distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    counts = pairs.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    return counts.withColumn("live", (F.col("n_owners") <= LIVE_OWNERS) & (F.col("n_repositories") <= LIVE_REPOSITORIES))


def classify(df: DataFrame, owner: str = "source", repository: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``secrets``: array of (start, kind, end, live) of base spans and live-looking generic tokens, in order."""
    scratch = Scratch(df.sparkSession, "secrets")
    found = scan(df.drop("secrets", "__found", "__row"), text)
    found = scratch.cut((found if keep_text else found.drop(text)).withColumn("__row", F.monotonically_increasing_id()))
    single = found.select("__row", F.explode("__found").alias("s")).select("__row", "s.*")
    owners = ownership(found, owner, repository).select("value", "live")
    judged = single.join(owners, "value").filter((F.col("kind") < 3) | F.col("live"))
    per_row = judged.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("secrets"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return found.drop("__found").join(per_row, "__row", "left").withColumn("secrets", F.coalesce("secrets", none)).drop("__row")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the spans of ``secrets`` in ``text``: ``[SECRET]`` where live, ``[EXAMPLE]`` where widely copied; overlapping spans merge."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_redacted(t.as_py(), s.as_py()) for t, s in zip(texts, spans, strict=True)], pa.string())

    found = F.size("secrets") > 0
    return df.withColumn(text, F.when(found, cut(F.when(found, F.col(text)), F.when(found, F.col("secrets")))).otherwise(F.col(text))).drop("secrets")


def _redacted(text: str | None, spans) -> str | None:  # noqa: ANN001
    if text is None or spans is None or len(spans) == 0:
        return text
    out, at, merged = [], 0, []
    for s in spans:
        if merged and s["start"] < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], s["end"]), merged[-1][2] or s["live"])
        else:
            merged.append((s["start"], s["end"], s["live"]))
    for start, end, live in merged:
        out += [text[at:start], "[SECRET]" if live else "[EXAMPLE]"]
        at = end
    return "".join(out) + text[at:]


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    judged = classify(read(spark, sf_dir, "documents", "doc_id", "source", "text"), keep_text=False)
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return judged.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(named(base).cast("binary"), 256).alias("base_sha256"),
        named(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
SQL: dict[str, str] = {}
