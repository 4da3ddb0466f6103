"""Text functions as Spark columns: tokenisers, normalisers, slugs, estimates, snippets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corvane.runtime import importable

# Words that are no anchors, and articles that answers are compared without.
ANCHOR_STOP_WORDS = (
    "about", "after", "again", "against", "also", "and", "are", "because", "before", "between", "but", "can", "could", "does", "for", "from", "has",
    "have", "how", "into", "not", "our", "that", "the", "their", "then", "there", "this", "through", "was", "what", "when", "where", "which", "with",
    "would",
)
ARTICLES = ("a", "an", "the")


_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_WORD = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    """The one tokeniser of lexical search: the compatibility form (which Spark has no function for), camelCase split, lower case, runs of letters and digits."""
    if not text:
        return []
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _WORD.findall(_CAMEL.sub(r"\1 \2", text).lower())


def bm25_tokens(text: Column) -> Column:
    """``tokens_of`` as a column, batch by batch; null text has none."""
    importable(SparkSession.active())

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(tokens_of, na_action=None)

    return tokens(text)


def compatible(text: Column) -> Column:
    """The compatibility form (NFKC) of a text; rows that are ASCII are passed on."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action=None)

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(form(text))


def mmr_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII tokens of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: F.length(w) >= 3))


def anchor_terms(text: Column) -> Column:
    """Distinct tokens that may anchor a query, in order of appearance."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_./:@+-]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(raw, lambda w: (F.length(w) >= 3) & ~w.isin(*ANCHOR_STOP_WORDS) & w.rlike(r"[\p{L}\p{N}]")))


def normal_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation and other letters to spaces, articles dropped."""
    return F.array_join(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def singular(word: Column) -> Column:
    """Light plural stemmer."""
    return (
        F.when(word.isin("evals", "evaluations", "evaluation"), "eval")
        .when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.rlike("(ss|us|is|ias)$"), F.substring(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case ASCII letters and digits joined by dashes; accents are dropped from Latin letters. Empty where nothing is left."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most), r"-+$", "")


def title_slug(title: Column, fallback: str = "note") -> Column:
    """Slug of a title, or the fallback with eight digits of the title's hash."""
    return F.when(slug(title) != "", slug(title)).otherwise(F.concat(F.lit(f"{fallback}-"), F.substring(F.sha2(title.cast("binary"), 256), 1, 8)))


def token_estimate(text: Column) -> Column:
    """A token for four characters of trimmed text, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.trim(text)) / 4)).cast("long")


def one_line(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, cut text ending in an ellipsis."""
    flat = one_line(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def claims(text: Column) -> Column:
    """Sentences and lines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), F.trim), lambda c: c != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets."""
    distinct = F.array_distinct(a)
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(F.transform(distinct, lambda t: F.least(count(a, t), count(b, t))), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(common == 0, 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def duration_seconds(text: Column) -> Column:
    """Seconds of a literal such as 30d or 24h; null where it is none."""
    unit = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d|w)$", 2)
    scale = F.when(unit == "ms", 0.001).when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0).when(unit == "w", 604800.0)
    return F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d|w)$", 1).try_cast("double") * scale


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: ** crosses folders, * and ? don't; {a,b} are alternatives and [a-c] or [!a-c] classes."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c, size = glob[i], 1
        if glob.startswith("**/", i):
            c, size = "(?:.*/)?", 3
        elif glob.startswith("**", i):
            c, size = ".*", 2
        elif c == "[" and "]" in glob[i + 2 :]:
            size = glob.index("]", i + 2) - i + 1
            inside = glob[i + 1 : i + size - 1]
            c = f"[^{inside[1:]}]" if inside[0] in "!^" else f"[{inside}]"
        elif c == "{" and "}" in glob[i:]:
            c, depth = "(?:", depth + 1
        elif depth and c in ",}":
            c, depth = ("|", depth) if c == "," else (")", depth - 1)
        elif c in "*?":
            c = "[^/]*" if c == "*" else "[^/]"
        elif not c.isalnum() and c not in "/_-":
            c = "\\" + c
        out, i = out + c, i + size
    return f"^{out}$"
