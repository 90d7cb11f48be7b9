"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Features are hashed to a fixed number of weights: words, pairs of neighbouring words, shapes of words (letter case,
digits, the marks around them) and pairs of shapes with a note whether a word repeats its neighbour. A value is the
feature's share of the document, so a score is a sparse dot product, summed as the words come.

Fitting uses a bounded sample of the labelled rows, chosen by a hash of the id. It is dealt to a fixed number of
shards; each makes its online passes in an order fixed by hashes, and their weights are averaged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import blocks
from provena.llm.common import doc_hash_remainder, numbered_words, worker_memo

SIZE = 1 << 20  # weights
SAMPLE = 32_768  # labelled rows to fit on, about
SHARDS = 16
PASSES = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-2
SCALE = 10.0  # of a feature that every word has
THRESHOLD = 0.3
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _C[1]
    x = (x ^ x >> np.uint64(27)) * _C[2]
    return x ^ x >> np.uint64(31)


def shape_of(word: bytes) -> tuple[bytes, bytes]:
    """(core, shape): the word without marks at its ends, in lower case; its kind of letters with those marks."""
    text = word.decode("utf-8", "replace")
    a, b = 0, len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    core = text[a:b]
    kind = "-" if not core else "9" if core.isdigit() else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa" if core[0].isupper() and core[1:].islower() else "mix"
    long_ = "+" if len(core) > 20 else ""
    return core.lower().encode(), f"{text[:a][:4]}{kind}{long_}{text[b:][:4]}".encode()


class Hasher:
    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the cores and of the shapes."""
        memo: dict[bytes, tuple[int, int]] = worker_memo("classifier")
        if len(memo) > 200_000:
            memo.clear()
        small = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
        for w in words:
            if w not in memo:
                core, shape = shape_of(w)
                memo[w] = small(core), small(b"\n" + shape)
        both = np.array([memo[w] for w in words], np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features of every word in order, shape (words, 4), words in each text); a text's last pair is with nothing."""
        words, flat, sizes, _ = numbered_words(texts)
        core, shape = (h[flat] for h in self.hashes(words))
        ends = np.cumsum(sizes[sizes > 0]) - 1
        after, shape_after = np.append(core[1:], np.uint64(0)), np.append(shape[1:], np.uint64(0))
        after[ends] = shape_after[ends] = 7
        same = (core == after).astype(np.uint64)
        made = [core, core * _C[0] + after, shape + np.uint64(1), shape * _C[0] + shape_after + same]
        return np.stack([(_mix(m) >> np.uint64(44)).astype(np.int32) for m in made], 1), sizes


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights and, last, the bias, after online passes over (features, values, label)."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            m = n[at]
            z[at] += g - (np.sqrt(m + g * g) - np.sqrt(m)) / ALPHA * w
            n[at] = m + g * g
    return weights(slice(None))


_HASHER = Hasher()


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features and their values of each labelled document."""
    for batch, texts in blocks(batches):
        every, sizes = _HASHER.features(texts)
        at, values, end = [], [], 0
        for n in sizes:
            own, count = np.unique(every[end : end + n], return_counts=True)
            end += n
            at.append(own.astype(np.int32).tobytes())
            values.append((count * (SCALE / max(1, n))).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("turn"), batch.column("label"), pa.array(at, pa.binary()), pa.array(values, pa.binary())],
            ["shard", "turn", "label", "at", "x"],
        )


def _fit_shard(table: pa.Table) -> pa.Table:
    table = table.sort_by([("turn", "ascending"), ("label", "ascending"), ("at", "ascending")])
    rows = []
    for at, x, y in zip(table.column("at").to_pylist(), table.column("x").to_pylist(), table.column("label").to_pylist(), strict=True):
        rows.append((np.append(np.frombuffer(at, np.int32), SIZE), np.append(np.frombuffer(x, np.float32), 1.0).astype(np.float64), y))
    return pa.table({"w": pa.array([fit(rows).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([len(rows)], pa.int64())})


def training_rows(labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label) to learn from: rows whose crc32 remainder by 5 is not 0, of one label 0 or 1, about `sample` of them.

    Null ids and labels, other values and ids with both labels are left out; repeated rows count once.
    """
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter((doc_hash_remainder(F.col("doc_id"), 5) != 0) & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    share = min(1.0, sample / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights averaged over the shards, zeros where there is nothing to learn from."""
    chosen = F.broadcast(training_rows(labels, sample=sample))  # about `sample` rows of a few bytes
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")
    rows = rows.withColumn("turn", F.xxhash64("doc_id", F.lit(1))).withColumn("shard", F.pmod("turn", F.lit(SHARDS)).cast("int"))
    made = rows.select("text", "shard", "turn", "label").mapInArrow(_featured, "shard int, turn long, label int, at binary, x binary")
    out, total = np.zeros(SIZE + 1), 0
    for r in made.groupBy("shard").applyInArrow(_fit_shard, "w binary, n long").collect():  # a fixed number of weight vectors
        out += r["n"] * np.frombuffer(r["w"], np.float32)
        total += r["n"]
    return (out / max(1, total)).astype(np.float32)


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    every, sizes = _HASHER.features(texts)
    sums = np.zeros(len(texts))
    some = sizes > 0
    if some.any():
        sums[some] = np.add.reduceat(weights[every].sum(1), (np.cumsum(sizes) - sizes)[some])
    return 1 / (1 + np.exp(-np.clip(sums * SCALE / np.maximum(1, sizes) + weights[SIZE], -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    held_out marks the rows that are never learnt from. Null and empty texts score by the bias alone; a null id
    is not held out, as no label can name it; repeated rows are scored each; texts of any length are whole; other
    columns are ignored. Without labels every score is 0.5; no documents give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts, sent.value), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are predicted to be good, with all their columns, whatever their names.

    Rows are judged each, also repeated ones and those with a null id or text; null and empty texts by the bias alone.
    Texts of any length are whole. Without labels every row stays; no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield batch.filter(pa.array(scores(texts, sent.value) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(doc_hash_remainder(doc_id, 5) == 0, F.lit(False))
