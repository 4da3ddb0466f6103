"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is an integer count and every rule compares ``scale * numerator`` with ``bound * denominator``, so a
verdict never depends on floating-point rounding. Null and empty texts have no words; they fail the length rule.
Rows are judged one by one and whole texts of any length are read: ties and repeated rows change nothing, nulls elsewhere
don't matter, and empty tables give empty results. Extra columns pass through, but for those named like the added ones, which
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, read, words_of

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "it", "for", "was", "on", "are", "as", "with", "is", "at", "by", "this", "from", "or", "be", "an", "a",
    "he", "she", "you", "not", "have", "had", "which", "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "est", "dans",
    "pour", "par", "sur", "au", "aux", "il", "elle", "avec", "ce", "ne", "pas", "se", "plus", "der", "die", "das", "den", "dem", "ein", "eine", "und",
    "ist", "von", "zu", "mit", "nicht", "auf", "für", "im", "als", "auch", "es", "an", "werden", "aus", "er", "hat", "sich", "sie", "el", "los",
    "las", "del", "una", "y", "es", "por", "con", "para", "como", "se", "su", "al", "lo", "más", "o", "pero", "sus",
)

#: Windows of so many words count as repeats when found twice in a text.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails a document when ``scale * numerator`` is beyond ``bound * denominator`` on the given side."""

    name: str
    numerator: str
    side: str
    bound: int
    denominator: str | None = None
    scale: int = 1

    def failed(self) -> Column:
        left = F.col(self.numerator) * F.lit(self.scale)
        right = F.lit(self.bound) if self.denominator is None else F.col(self.denominator) * F.lit(self.bound)
        return left < right if self.side == "<" else left > right

    def sql(self) -> str:
        right = str(self.bound) if self.denominator is None else f"{self.bound} * {self.denominator}"
        return f"({self.scale} * {self.numerator} {self.side} {right})"


#: Rules that every caller gets: too short, or built from repeated windows.
BASE_RULES = (
    Rule("few_words", "n_words", "<", 20),
    Rule("repeated_words", "n_repeat_words", ">", 30, "n_words", 100),
)
#: The table of production thresholds.
RULES = (
    Rule("many_words", "n_words", ">", 1_000_000),
    Rule("short_words", "word_chars", "<", 2, "n_words"),
    Rule("long_words", "word_chars", ">", 20, "n_words"),
    Rule("symbols", "n_symbols", ">", 40, "n_words", 100),
    Rule("shouting", "n_bangs", ">", 40, "n_words", 100),
    Rule("no_stop_words", "n_stop_words", "<", 1, "n_words", 200),
    Rule("repeated_lines", "n_dup_lines", ">", 60, "n_lines", 100),
)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules speak of: n_words, word_chars, n_symbols, n_bangs, n_stop_words, n_lines, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = df.withColumns({"__w": words_of(F.col(text)), "__lines": lines})
    step = step.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "__g": F.when(
                F.size("__w") >= WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("__w") - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    step = step.withColumn(
        "__s",
        F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    twin = lambda x, j: (F.get("__s", j - 1)["h"] == x["h"]) | (F.get("__s", j + 1)["h"] == x["h"])
    starts = F.array_sort(F.transform(F.filter("__s", twin), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    return step.withColumns(
        {
            "word_chars": F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_bangs": F.regexp_count(body, F.lit(r"[!?]")).cast("long"),
            "n_stop_words": F.size(F.filter("__w", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("__s") > 0, covered).otherwise(F.lit(0).cast("long")),
        }
    ).drop("__w", "__lines", "__g", "__s")


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add the measures, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``."""
    counted = measures(df, text)
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.failed()
    named = F.filter(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*BASE_RULES, *rules)]), lambda x: x.isNotNull())
    return counted.withColumns({"base_failed": base, "failed_rules": named}).withColumn("kept", F.size("failed_rules") == 0)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents", "doc_id", "text")).select(*COLUMNS)


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    base = " OR ".join(r.sql() for r in BASE_RULES)
    rest = " OR ".join(r.sql() for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM e WHERE len(w) >= {WINDOW}),
g AS (SELECT rid, pos, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS gram FROM u),
r AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE len(gram) = {WINDOW}),
c AS (SELECT rid, count(DISTINCT pos + k.k) AS n_repeat_words FROM r, range({WINDOW}) AS k(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_bangs,
             len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM e LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
       NOT (({base}) OR ({rest})) AS kept FROM m
"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL = {"op10_quality_rules": _sql()}
