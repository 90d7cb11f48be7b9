"""Baselines of retrieval: an embedding hook, hashed TF-IDF vectors, and BM25 over an inverted index."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import tokens
from provena.operators.inverted import best_documents, bm25_part, build_index
from provena.sources.stored import stored

Embedder = Callable[[pd.Series], pd.Series]  # texts -> lists of floats, batch by batch


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "vector") -> DataFrame:
    """Add a vector by any model that takes a batch of texts; a null text gives null."""
    made = F.pandas_udf(lambda s: embedder(s), "array<double>")
    return df.withColumn(out, F.when(F.col(text).isNotNull(), made(F.coalesce(F.col(text), F.lit("")))))


def word_bucket(word: Column, buckets: int = 256) -> Column:
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def words_of(text: Column) -> Column:
    """All words of letters, digits and _, lower-cased, repeats too."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))


def tf_idf(docs: DataFrame, key: str, text: str, buckets: int = 256) -> DataFrame:
    """(key, bucket, weight): hashed term frequencies by inverse document frequency, of length one by document.

    Frequencies of documents are one row a bucket; a document without words has no rows.
    """
    counts = docs.select(key, F.explode(words_of(F.col(text))).alias("w")).groupBy(key, word_bucket(F.col("w"), buckets).alias("bucket")).agg(F.count("*").alias("tf"))
    counts = stored(counts, "bucket-counts")  # read three times; texts are cut once
    n = docs.select(F.count("*").alias("n"))
    df = counts.groupBy("bucket").agg(F.count("*").alias("df")).crossJoin(n).select("bucket", F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    raw = counts.join(F.broadcast(df), "bucket").withColumn("x", F.col("tf") * F.col("idf"))  # a row for each bucket
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, key).filter("norm > 0").select(key, "bucket", (F.col("x") / F.col("norm")).alias("weight"))


def bm25(queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str = "text", k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by BM25 over its distinct words, ties to the smaller document.

    Documents are tokenised once, into a stored index whose blocks are skipped where they cannot hold a better document.
    """
    asked = queries.select(query, F.explode(tokens(F.col(text))).alias("word"))
    index = build_index(docs, doc, words_of(F.col(text)))
    return best_documents(index, asked, query, bm25_part(k1, b), k).best.withColumnRenamed("doc", doc)
