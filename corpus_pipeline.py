"""From documents to packed training sequences: five stages over what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.

Null and empty texts have no words, so the quality rules drop them; texts of any length
are read whole; of equal rows one stays; an empty table of documents gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qasidalake.llm import near_duplicates, packing, quality_classifier, quality_rules, secrets
from qasidalake.llm.common import read_table, written
from qasidalake.llm.queries import BYTE_BPE_RANKS


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.without_near_duplicates(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by marks; n_chars follows the text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("near-duplicates", deduplicated),
    ("secret scans", redacted),
    ("packing", packed),
]

#: SQL cannot train the classifiers or draw the samples; tests hold the rules, the classes and the packing against
#: brute force on each stage's own input, and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "kept-by-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
