"""From raw documents to token ids: quality rules, near duplicates, benchmark passages, personal data, byte-level BPE.

Every stage works on all that the one before it kept, and all but the last return the columns of documents.
Null and empty texts, ties, repeated rows, empty tables and further columns are handled as the operators say:
texts without words fail the quality rules, repeated rows are one group, other columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, pii, quality, simhash
from riskloom.llm.common import new_folder, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every group of near duplicates."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.mask_personal_data(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the digests of ids and of the text decoded from them, of all documents."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_and_decode(docs, path, pattern).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("personal data", personal_data_masked),
    ("byte-level BPE", encoded),
]

#: SQL can state neither the groups of near duplicates nor the encoding; tests hold the stages against plain rewritings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
