"""A training corpus from raw documents: quality rules, near duplicates, repeated strings, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet in the shared folder and reads them again for the next; once that is written, they are deleted.
All but the last return documents' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import jaccard, packing, pfp_dedup, quality, secrets
from chronoloom.llm.common import discard, materialize, read

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the classifier go."""
    return quality.filter_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of smallest doc_id."""
    return jaccard.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """100-byte strings that also start earlier are taken out of the texts."""
    return pfp_dedup.strip_repeats(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in the texts are replaced by a mark."""
    return secrets.redact(docs, secrets.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full training sequences, with a CRC-32 beside their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_strings), ("secret scans", secret_redaction), ("packing", pack_sequences)]

#: Models, MinHash and tokenizers take part, which SQL cannot express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
        if i:
            discard(before)
    return docs
