"""The corpus pipeline: stages over ``documents``, each calling one operator.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Language ID drops documents without a
language; the Jaccard join keeps one document of each group of near copies; the secret scan redacts what it finds; mixing
keeps a sample by calibrated probabilities; the last stage encodes what is left.

Documents are rows: nulls, repeated rows and texts of any length are carried as each operator's docstring says, ties go as
the operators break them, and extra columns pass all stages but the last under their own names, whatever these are. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, jaccard, langid, mixing, secrets
from corvane.llm.common import Scratch, importable


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs, and all others in one, so that no name can clash with the operator's."""
    return docs.select(*needed, F.struct(F.lit(0).alias("__none"), *[c for c in docs.columns if c not in needed]).alias("__rest"))


def _unpacked(df: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    return df.select(*[F.col(c) if c in needed else F.col("__rest")[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents themselves; those of no language go."""
    importable(spark)
    model = langid.fit(docs)
    told = langid.identify(_packed(docs, "text"), model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return _unpacked(told, docs, "text")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the smallest id stays; documents without words or id all stay."""
    importable(spark)
    groups = jaccard.join(docs.select("doc_id", "text"))
    dropped = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["__gone"], "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced in the texts, and the lengths follow."""
    importable(spark)
    needed = ("doc_id", "source", "text")
    cleaned = _unpacked(secrets.redact(secrets.classify(_packed(docs, *needed))), docs, *needed)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return cleaned


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, languages and topics by raked weights."""
    return mixing.mix(docs).filter("__kept").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and the digests of ids and decoded bytes."""
    import public_tokenizers

    importable(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("mixing_sources", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: Hashes, automata and merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again as the next one's input.

    A stage's table goes when its successor's stands; the last one goes with the driver, as the result still reads it.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
