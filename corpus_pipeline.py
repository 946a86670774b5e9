"""From raw documents to packed sequences, in stages.

Each stage gets what the stage before it wrote; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm.mixing import mixed_documents
from tabkit.llm.packing import pack_documents
from tabkit.llm.quality import keep_good
from tabkit.llm.secret_scan import mask_secrets
from tabkit.llm.simhash import one_of_each
from tabkit.sources import read_table, shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the base test or a rule go."""
    return keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return one_of_each(docs, radius=3, shingle=3, seed=42)


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets in texts are replaced."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents with their place in a sequence."""
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = pack_documents(docs, path, payload=F.crc32("ids"))
    return packed.withColumnRenamed("ids", "ids_crc32")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fingerprints, samples and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = read_table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, folder)
