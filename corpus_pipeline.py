"""From raw documents to training tokens: five stages, each on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.llm import bpe, decontam, near_dups, pseudonyms, quality_rules
from helioframe.llm.common import bounded_batches, table, written
from helioframe.llm.queries import BYTE_BPE, PSEUDONYM_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bounded_batches(spark)
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dups.deduplicated(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bounded_batches(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` follows the text."""
    new = pseudonyms.pseudonymised(docs, key=PSEUDONYM_KEY)
    return new.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    bounded_batches(spark)
    rows = bpe.encoded(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, into="bpe")
    said = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("bpe.ids").cast("bigint").alias("n_tokens"),
        F.col("bpe.ids").alias("ids"),
        (F.col("bpe.decoded") == said).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality),
    ("near duplicates", dedup),
    ("decontamination", decontaminate),
    ("pseudonyms", pseudonymise),
    ("byte-level BPE", encode),
]

# Exact binomial bounds, keyed permutations and BPE have no SQL form; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
