"""A training corpus from raw documents: quality rules, near copies, benchmark passages, source weights, token ids.

Each stage works on all rows that the one before kept; what it returns is written as Parquet and read again. Stages take
nulls in any column, empty and very long texts, repeated rows and empty tables; columns beside those of documents go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontamination, mixing, ngram_join, quality_rules, token_output
from pagewright.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy v1. Null and empty texts have too few words, so they go; repeated rows stay."""
    return quality_rules.apply_policy(docs.select(*COLUMNS), "v1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id; of repeated rows one. Rows without doc_id stay."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null texts have none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes; some documents come twice, some not at all, and those without words
    never. A null source is a source."""
    return mixing.mix(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the written shards; null ids come first."""
    return token_output.read(spark, token_output.write(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality rules", quality), ("near copies", near_copies), ("decontamination", decontaminated), ("mixing", mixed), ("token ids", token_ids)]

#: SQL has no tokenizer; the test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
