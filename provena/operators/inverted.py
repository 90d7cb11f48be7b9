"""A stored inverted index with maxima by block of documents, and exact best documents that skip blocks.

Documents of like length form blocks of bounded size. The index holds one row for each word and block: the documents there
with how often they hold the word, and the most favourable count and length among them. A query's bound for a block is the
sum of its words' bounds there; blocks whose bound is below the k-th score found in the best ones are not opened. A word
that stands in all documents is as many rows as there are blocks, so that no task holds its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from provena.sources.stored import stored

BLOCK_DOCS = 128
FIRST = 2  # blocks of a query that are opened whatever their bounds
UNIT_QUERIES = 4096  # queries that meet a block at a time, on average
SEPARATOR = "\n"  # between the words of a document in one text, so that no word may hold it
SLACK = 1e-9  # share of a score by which rounding might move a bound

Part = Callable[[Column, Column], Column]  # (count in the document, its length), beside n, df and mean -> a word's part of the score


class Index(NamedTuple):
    """postings: (word, block, docs array<struct<doc, tf, length>>, most, least). words: (word, df). about: one row (n, mean)."""

    postings: DataFrame
    words: DataFrame
    about: DataFrame


def build_index(docs: DataFrame, doc: str, words: Column, block_docs: int = BLOCK_DOCS) -> Index:
    """Write the index of documents by their words, an array that may repeat; ids must be unique.

    Documents are split into words once; no word may hold a line feed. Lengths are quarters of a doubling apart between kinds of blocks, and a kind has as
    many blocks as its documents need; a block's documents are counted in one task, so that no single word is moved.
    """
    held = docs.select(F.col(doc).alias("doc"), words.alias("words")).withColumn("length", F.size("words")).withColumn("words", F.array_join("words", SEPARATOR))
    held = stored(held.withColumn("kind", F.floor(F.log2(F.col("length") + 1.0) * 4)), "indexed-documents")
    kinds = held.groupBy("kind").agg(F.ceil(F.count("*") / block_docs).alias("parts"))  # a few dozen rows
    lengths = held.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    block = F.shiftleft("kind", 40) + F.pmod(F.xxhash64("doc"), F.col("parts"))
    placed = held.join(F.broadcast(kinds), "kind").select(block.alias("block"), "doc", "length", "words").filter("length > 0")
    doc_type = held.schema["doc"].dataType.simpleString()
    postings = stored(placed.groupBy("block").applyInArrow(_postings_of, f"block long, word string, docs array<struct<doc:{doc_type},tf:int,length:int>>, most int, least int"), "postings")
    return Index(postings, stored(postings.groupBy("word").agg(F.sum(F.size("docs")).alias("df")), "posting-words"), stored(lengths, "posting-lengths"))


def _postings_of(block: pa.Table) -> pa.Table:
    """The postings of one block's documents, counted word by word where the block lies."""
    length = block.column("length").to_numpy()
    number: dict[str, int] = {}
    word, at, tf = [], [], []
    for i, text in enumerate(block.column("words").to_pylist()):
        counts = Counter(text.split(SEPARATOR))
        word += [number.setdefault(w, len(number)) for w in counts]
        at += [i] * len(counts)
        tf += counts.values()
    order = np.argsort(np.array(word, np.int64), kind="stable")
    word, at, tf = (np.array(x, np.int64)[order] for x in (word, at, tf))
    starts = np.searchsorted(word, np.arange(len(number)))
    docs = pa.StructArray.from_arrays([block.column("doc").combine_chunks().take(pa.array(at)), pa.array(tf, pa.int32()), pa.array(length[at], pa.int32())], ["doc", "tf", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(word)), pa.int32()), docs)
    return pa.table(
        {
            "block": pa.array(np.full(len(number), block.column("block")[0].as_py()), pa.int64()), "word": pa.array(list(number), pa.string()), "docs": lists,
            "most": pa.array(np.maximum.reduceat(tf, starts), pa.int32()), "least": pa.array(np.minimum.reduceat(length[at], starts), pa.int32()),
        }
    )


def _meet(asked: DataFrame, postings: DataFrame, query: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over the rows (query, block, word) of some queries and the postings (block, word, ...) of a block, where both have any.

    Words move once by block, whatever number of queries asks for them; queries come in parts of bounded size.
    """
    n = asked.select(query).distinct().count()
    parts = max(1, -(-n // UNIT_QUERIES))
    mine = asked.select(F.col(query).alias("query"), "block", "word", F.pmod(F.xxhash64(query), F.lit(parts)).alias("part"))
    theirs = postings.select(*(F.col(c).alias(c) for c in postings.columns), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def unit(a: pa.Table, b: pa.Table) -> pa.Table:
        return run(a, b) if a.num_rows and b.num_rows else pa.schema(fields).empty_table()

    return mine.groupBy("block", "part").cogroup(theirs.groupBy("block", "part")).applyInArrow(unit, schema)


class _Asked:
    """The pairs of a query of the part and a posting of the block, and the block's documents in a row."""

    def __init__(self, asked: pa.Table, postings: pa.Table):
        place = {w: i for i, w in enumerate(postings.column("word").to_pylist())}
        queries, words = asked.column("query").combine_chunks().dictionary_encode(), asked.column("word").to_pylist()
        self.queries, of = queries.dictionary, queries.indices.to_numpy()
        found = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
        order = np.argsort(of, kind="stable")
        order = order[found[order] >= 0]
        self.of, self.found = of[order], found[order]
        self.bounds = np.searchsorted(self.of, np.arange(len(self.queries) + 1))
        docs = postings.column("docs").combine_chunks()
        self.starts = np.append(0, np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False))).astype(np.int64)
        ids = docs.flatten().field("doc").dictionary_encode()
        self.docs, self.at = ids.dictionary, ids.indices.to_numpy()
        self.flat = docs.flatten()

    def matrix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.starts) - 1, len(self.docs)))
        out[np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), self.at] = values
        return out

    def each(self):
        for i in range(len(self.queries)):
            if self.bounds[i + 1] > self.bounds[i]:
                yield i, self.found[self.bounds[i] : self.bounds[i + 1]]


def bm25_part(k1: float = 1.2, b: float = 0.75) -> Part:
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return lambda tf, length: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("mean")))


def shared_part(tf: Column, length: Column) -> Column:
    """One for each shared word."""
    return F.lit(1.0)


class Found(NamedTuple):
    """best: (query, doc, score, rank). bounds: (query, block, bound, postings, opened) of every block that holds a query's word."""

    best: DataFrame
    bounds: DataFrame


def best_documents(index: Index, asked: DataFrame, query: str, part: Part, k: int) -> Found:
    """The k best documents of each query, given as distinct (query, word), by the sum of the words' parts; ties to the smaller document.

    A word's part must not fall with its count nor rise with the length. Scores are compared when rounded to nine digits.
    """
    terms = stored(asked.select(query, "word").join(index.words, "word").crossJoin(F.broadcast(index.about)), "posting-terms")  # one row
    wanted = terms.select("word", "n", "df", "mean").distinct()
    held = index.postings.join(wanted, "word")
    weights = F.transform("docs", lambda d: F.struct(d["doc"].alias("doc"), part(d["tf"], d["length"]).cast("double").alias("part")))
    heads = held.select("word", "block", part(F.col("most"), F.col("least")).alias("bound"), F.size("docs").alias("postings"))
    met = terms.select(query, "word").join(heads, "word").groupBy(query, "block").agg(F.sum("bound").alias("bound"), F.sum("postings").alias("postings"))
    order = Window.partitionBy(query).orderBy(F.desc("bound"), "block")
    met = stored(met.withColumn("turn", F.row_number().over(order)), "posting-bounds")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    types = kind(terms, query), kind(index.postings.select(F.explode("docs").alias("d")).select("d.doc"), "doc")

    def best_of(asked: pa.Table, postings: pa.Table) -> pa.Table:
        a = _Asked(asked, postings)
        weight, there = a.matrix(a.flat.field("part").to_numpy(zero_copy_only=False)), a.matrix(np.ones(len(a.at)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, rows in a.each():
            scores = weight[rows].sum(0)
            some = np.flatnonzero(there[rows].any(0))
            if len(some) > k:  # with all that rounding might put among the k best; the order is settled in the merge
                some = some[scores[some] >= np.partition(scores[some], len(some) - k)[len(some) - k] - 1e-8]
            found.append((np.full(len(some), i), some, scores[some]))
        q, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([a.queries.take(pa.array(q)), a.docs.take(pa.array(d)), pa.array(s)], ["query", "doc", "score"])

    def score(blocks: DataFrame) -> DataFrame:
        pairs = terms.select(query, "word").join(blocks.select(query, "block"), query)
        some = _meet(pairs, held.select("block", "word", weights.alias("docs")), query, best_of, f"query {types[0]}, doc {types[1]}, score double")
        return some.withColumnRenamed("query", query)

    first = stored(score(met.filter(F.col("turn") <= FIRST)), "posting-first")
    nth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "doc"))
    bars = first.withColumn("r", nth).filter(F.col("r") == k).select(query, F.col("score").alias("bar"))
    judged = met.join(bars, query, "left").withColumn("opened", (F.col("turn") <= FIRST) | F.col("bar").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("bar")))
    found = first.unionByName(score(judged.filter((F.col("turn") > FIRST) & F.col("opened"))))
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "doc")
    return Found(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), judged.select(query, "block", "bound", "postings", "opened"))


def matching_documents(index: Index, asked: DataFrame, query: str) -> DataFrame:
    """(query, n_documents): how many documents hold any of a query's words; sets of documents meet within blocks."""
    asked = asked.select(query, "word").distinct()
    held = index.postings.join(asked.select("word").distinct(), "word", "left_semi")
    pairs = asked.join(held.select("word", "block"), "word")

    def count(asked: pa.Table, postings: pa.Table) -> pa.Table:
        a = _Asked(asked, postings)
        there = a.matrix(np.ones(len(a.at)))
        made = [(i, int(there[rows].any(0).sum())) for i, rows in a.each()]
        return pa.table([a.queries.take(pa.array([i for i, _ in made], pa.int64())), pa.array([n for _, n in made], pa.int64())], ["query", "n"])

    within = _meet(pairs, held.select("block", "word", "docs"), query, count, f"query {asked.schema[query].dataType.simpleString()}, n long")
    return within.groupBy(F.col("query").alias(query)).agg(F.sum("n").alias("n_documents"))


def opened_share(found: Found) -> DataFrame:
    """One row: how many postings of the queries' words there are in all, and how many of them were opened."""
    return found.bounds.agg(F.sum("postings").alias("postings"), F.sum(F.when(F.col("opened"), F.col("postings")).otherwise(0)).alias("opened"))
