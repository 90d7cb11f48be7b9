"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Documents that the quality classifier or the quality rules reject go, one document of each near-duplicate class
stays, secrets are replaced by marks, and what is left is packed into token windows. The first four stages return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provena.llm import classifier, dartminhash, packing, quality_rules, secrets
from provena.llm.common import materialize, table
from provena.llm.queries import tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("near-duplicates", deduplicate),
    ("secrets", redact),
    ("packing", pack),
]

#: SQL expresses neither the fitted classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of documents; no documents give no rows, texts of any length go through whole.

    Rows with a null or empty text fall to the rules; of rows that share an id, and of copies that tie, one stays; rows with a null id are
    classes of their own. Further columns pass through the first four stages as they are.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
