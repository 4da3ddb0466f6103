"""High recall: a wide pool of candidates filtered by rules, and questions taken apart, asked part by part within a budget.

All queries of a batch go through the rules together; what is a loop for one query is windows over its candidates here, of which the pool
bounds the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import anchor_terms, compatible, one_line

# Hits of a source, characters of a fingerprint; parts of a question and candidates of all parts; where questions part.
SOURCE_CAP, FINGERPRINT = 3, 800
PARTS, CANDIDATES = 4, 80
PART_AT = r"(?iu)\s+(?:and|then|while|where|which|who|that|because|before|after)\s+"
BETWEEN = r"(?iu)\bbetween\s+(.+?)\s+and\s+(.+?)(?:[?.]|$)"
EDGES = "^[,;: -]+|[,;: -]+$"


def high_recall(candidates: DataFrame, k: int, cap: int = SOURCE_CAP) -> DataFrame:
    """Why each candidate (query_id, query, id, source, chunk_index, text, rank, lexical) goes, or null: duplicate_collapse, source_diversity_cap or anchor_filter.

    Of equal texts of a source the best-ranked stays. A source gives ``cap`` hits, and more only while fewer than ``k`` are kept. What is left must be a
    lexical hit, hold one of the query's anchors, or be the chunk before or after one that does, unless fewer than ``k`` would be left then: the rule
    is ``relaxed`` for that query. ``neighbour`` tells what stays for the sake of the chunk beside it.
    """
    by, first = Window.partitionBy("query_id"), Window.partitionBy("query_id", "source")
    body = F.substring(F.trim(F.regexp_replace(F.lower(compatible(F.col("text"))), r"\s+", " ")), 1, FINGERPRINT)
    told = candidates.withColumn("print", F.sha1(F.concat(F.coalesce("source", F.lit("")).cast("binary"), F.lit(b"\x00"), body.cast("binary"))))
    told = told.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "print").orderBy("rank")) > 1)
    kept = F.col("copy") == F.lit(False)
    told = told.withColumn("place", F.sum(kept.cast("int")).over(by.orderBy("rank"))).withColumn("nth", F.sum(kept.cast("int")).over(first.orderBy("rank")))
    told = told.withColumn("stays", kept & ((F.col("place") <= k) | (F.col("nth") <= cap)))
    anchors = anchor_terms(compatible(F.col("query")))
    within = F.lower(F.concat_ws(" ", "text", "source"))
    told = told.withColumn("anchors", anchors).withColumn("anchored", F.col("stays") & (F.col("lexical") | F.exists("anchors", lambda a: F.contains(within, a))))
    beside = F.collect_set(F.when(F.col("anchored"), F.col("chunk_index"))).over(first)
    near = F.array_contains(beside, F.col("chunk_index") - 1) | F.array_contains(beside, F.col("chunk_index") + 1)
    told = told.withColumn("neighbour", F.coalesce((F.size("anchors") > 0) & F.col("stays") & ~F.col("anchored") & near, F.lit(False)))
    left, passed = F.count_if("stays").over(by), F.count_if(F.col("anchored") | F.col("neighbour")).over(by)
    told = told.withColumn("relaxed", (F.size("anchors") > 0) & (passed < F.least(F.lit(k), left)))
    goes = (F.size("anchors") > 0) & ~F.col("relaxed") & ~F.col("anchored") & ~F.col("neighbour")
    reason = F.when(F.col("copy"), "duplicate_collapse").when(~F.col("stays"), "source_diversity_cap").when(goes, "anchor_filter")
    return told.select("query_id", "id", "rank", reason.alias("reason"), (F.col("neighbour") & ~F.col("relaxed")).alias("neighbour"), "relaxed")


def trimmed(question: Column) -> Column:
    return F.regexp_replace(one_line(question), EDGES, "")


def aspects(question: Column) -> Column:
    """What a question (in its compatibility form) asks for: its parts between conjunctions, and the two sides of a ``between``."""
    plain = one_line(question)
    parts = F.filter(F.transform(F.split(plain, PART_AT), lambda p: F.regexp_replace(F.trim(p), EDGES, "")), lambda p: p != "")
    sides = F.array(*[F.trim(F.regexp_extract(plain, BETWEEN, g)) for g in (1, 2)])
    sides = F.when(plain.rlike(BETWEEN), sides).otherwise(F.array().cast("array<string>"))
    return first_of_each(F.concat(F.when(F.size(parts) > 1, parts).otherwise(F.array(trimmed(question))), F.transform(sides, lambda p: F.regexp_replace(p, EDGES, ""))))


def first_of_each(questions: Column) -> Column:
    """Without empty ones, and without those that an earlier one equals but for case."""
    keys = F.transform(questions, F.lower)
    return F.filter(questions, lambda q, i: (q != "") & (F.array_position(keys, F.lower(q)) == i + 1))


def subqueries(queries: DataFrame, query_id: str, text: str, parts: int = PARTS) -> DataFrame:
    """(query_id, part, subquery, parts, asked): the question itself and then its aspects, ``parts`` of them at most; ``asked`` is how many there would be."""
    asked = queries.select(F.col(query_id).alias("query_id"), compatible(F.col(text)).alias("asks"))
    all_ = first_of_each(F.concat(F.array(trimmed(F.col("asks"))), aspects(F.col("asks"))))
    rows = asked.select("query_id", F.slice(all_, 1, parts).alias("all"), F.size(aspects(F.col("asks"))).alias("asked"))
    return rows.select("query_id", F.size("all").alias("parts"), "asked", F.posexplode("all").alias("part", "subquery"))


def gathered(queries: DataFrame, query_id: str, text: str, parts: DataFrame, hits: DataFrame, k: int, candidates: int = CANDIDATES) -> DataFrame:
    """The k best pieces of evidence of each query: query_id, id, times, first_part, rank, and how the search ended (``iterations``, ``stop``).

    ``parts`` are those of ``subqueries``, ``hits`` (query_id, part, rank, id, text) what each part finds. Parts are asked in order; each may bring an equal
    share of the candidates, and all of them no more than ``candidates``. The search stops where all aspects are met by an anchor in some evidence.
    Evidence that several parts found comes first, and what the whole question alone found comes last.
    """
    share = F.ceil(F.lit(candidates) / F.col("parts")).cast("int")
    found = parts.select("query_id", "part", "parts", "asked").join(hits.groupBy("query_id", "part").agg(F.count("*").alias("n")), ["query_id", "part"], "left")
    before = F.coalesce(F.sum(F.least(F.coalesce("n", F.lit(0)), share)).over(Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = found.withColumn("before", before).filter(F.col("before") < candidates).select("query_id", "part", "parts", "asked", F.least(share, F.lit(candidates) - F.col("before")).alias("room"), (F.col("before") + F.least(F.coalesce("n", F.lit(0)), share) >= candidates).alias("full"))
    evidence = hits.join(budget.select("query_id", "part", "room"), ["query_id", "part"]).filter(F.col("rank") <= F.col("room"))
    asked = queries.select(F.col(query_id).alias("query_id"), compatible(F.col(text)).alias("asks"))
    wanted = asked.select("query_id", F.posexplode(aspects(F.col("asks"))).alias("aspect", "asks")).withColumn("anchors", anchor_terms(F.col("asks")))
    meets = (F.size("anchors") == 0) | F.exists("anchors", lambda a: F.contains(F.lower("text"), a))
    met = wanted.join(evidence.select("query_id", "part", "text"), "query_id", "left").groupBy("query_id", "aspect").agg(F.min(F.when(meets & F.col("text").isNotNull(), F.col("part"))).alias("at"))
    enough = met.groupBy("query_id").agg(F.when(F.count("at") == F.count("*"), F.max("at")).alias("enough"))
    ended = budget.groupBy("query_id").agg(F.max("part").alias("last"), F.bool_or("full").alias("full"), F.max("parts").alias("parts"), F.max("asked").alias("asked")).join(enough, "query_id", "left")
    stop = F.when(F.col("enough").isNotNull(), "sufficient").when(F.col("full"), "max_total_candidates").when((F.col("parts") >= PARTS) & (F.col("last") < F.col("asked")), "max_subqueries").otherwise("exhausted_subqueries")
    ended = ended.select("query_id", F.coalesce("enough", "last").alias("until"), stop.alias("stop"))
    pieces = evidence.join(ended, "query_id").filter(F.col("part") <= F.col("until")).groupBy("query_id", "id", "until", "stop").agg(F.count("*").alias("times"), F.min(F.struct("part", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy((F.col("first.part") == 0) & (F.col("times") == 1), F.desc("times"), "first.part", "first.rank")
    ranked = pieces.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", "times", F.col("first.part").alias("first_part"), "rank", (F.col("until") + 1).alias("iterations"), "stop")
