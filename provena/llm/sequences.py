"""The next word foretold by hashed contexts of the one and the two words before it, for the context-mixing model.

Every sequence of two and of three words of the training part is counted, whatever its words and however rare it is. The
counts lie in two tables of fixed size: contexts are hashed to buckets, and words to classes, the commonest to one of their
own; sequences that meet in a cell add up there, and none is left out. Fine classes lie within coarse ones. A word's
probability is that of its coarse class after the two words before, times that of its fine class within the coarse one after
the word before, times its own within its class, as the bytes tell it. Each count leans on the next lower probability
with a strength of its own; several pairs of strengths, one of which trusts no context, stand beside each other and are mixed
by weights that follow how well each has foretold the text so far.

All words together have a probability of one: what the bytes leave to words that are not of the head is a class of its own.
A training text is foretold by what is left when its own occurrences are taken out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import BLOCK, parts

FINE, COARSE = 2048, 64  # classes of words
OWN = 1024  # commonest words with a fine class of their own
ONE, TWO = 1 << 12, 1 << 16  # buckets of one word before and of two
OWN_ONE = 1 << 10  # commonest words with a bucket of their own
CELLS = ONE * FINE + TWO * COARSE
PIECE = 1 << 18  # cells in a row when tables are summed
FAN = 32  # tables that one task sums
WIDE = 4 * BLOCK  # bytes of texts whose words are looked up at once
WEAK = np.inf
#: How strongly counts after one word and after two lean on what is below them, and how much each pair is trusted at a text's beginning.
LEANS = np.array([(WEAK, WEAK), (2.0, 2.0), (20.0, 10.0), (200.0, 50.0), (2000.0, 500.0), (200.0, WEAK)])
TRUST = np.array([0.5, 0.1, 0.1, 0.1, 0.1, 0.1])
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _hash(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _M[0]
    return ((x ^ x >> np.uint64(29)) * _M[1]) >> np.uint64(33)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts with ASCII letters lower-cased, how many of them each text has); a null text has none.

    Arrow's white space is that of bytes.split; it leaves an empty word where it stands doubled or at either end of a text.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, n = split.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
    some = pc.binary_length(words).to_numpy() > 0
    if not some.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
        words = words.filter(pa.array(some))
    return words, n


def ranked(batches: Iterator[pa.RecordBatch], known: pa.Array, split=None) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """(part of a batch, its words, ranks of its tokens, tokens of each text): an end follows the words of each text.

    A token's rank is its place among the known words, their number where it is not there. split cuts a text, if not at white space.
    """
    end = pc.index_in(pa.scalar(b"", pa.binary()), value_set=known).as_py()
    for wide in parts(batches, most=WIDE):
        if split is None:
            words, n = words_in(wide.column("text"))
        else:
            cut = [split(t or "") for t in wide.column("text").to_pylist()]
            words, n = pa.array([w for ws in cut for w in ws], pa.binary()), np.array([len(ws) for ws in cut])
        ranks = pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy()
        row, word = 0, 0
        for part in parts(iter([wide])):
            sizes = n[row : row + part.num_rows]
            row, size = row + part.num_rows, int(sizes.sum())
            flat = np.insert(ranks[word : word + size].astype(np.int64), np.cumsum(sizes), len(known) if end is None else end)
            yield part, words.slice(word, size), flat, sizes + 1
            word += size


def fine_of(ranks: np.ndarray, n_head: int) -> np.ndarray:
    """The fine class of words by their ranks; the last one is that of all words that are not of the head."""
    hashed = OWN + (_hash(ranks) % np.uint64(FINE - 1 - OWN)).astype(np.int64)
    return np.where(ranks >= n_head, FINE - 1, np.where(ranks < OWN, ranks, hashed))


def cells_of(ranks: np.ndarray, starts: np.ndarray, end: int, n_head: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the cells of one and of two words before, in tables of their own; texts begin at starts, after an end."""
    before, second = np.empty_like(ranks), np.empty_like(ranks)
    before[1:], before[starts] = ranks[:-1], end
    second[1:], second[starts] = before[:-1], end
    fine = fine_of(ranks, n_head)
    one = np.where(before < OWN_ONE, before, OWN_ONE + (_hash(before) % np.uint64(ONE - OWN_ONE)).astype(np.int64))
    two = (_hash(before.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) % np.uint64(TWO)).astype(np.int64)
    return one * FINE + fine, two * COARSE + fine % COARSE


def _narrow(counts: np.ndarray) -> bytes:
    """A piece of PIECE counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _wide(piece: bytes) -> np.ndarray:
    return np.frombuffer(piece, f"u{len(piece) // PIECE}").astype(np.int64)


def class_shares(costs: np.ndarray) -> np.ndarray:
    """Probabilities of the fine classes, (classes of the gates, FINE), by the log10 probabilities of the head's words; what they leave is that of all others."""
    fine, p = fine_of(np.arange(len(costs)), len(costs)), 10 ** costs.astype(np.float64)
    out = np.stack([np.bincount(fine, p[:, k], FINE) for k in range(p.shape[1])])
    out[:, FINE - 1] = 1 - out.sum(1)
    return out


def count(docs: DataFrame, words: list[bytes], split=None) -> np.ndarray:
    """Counts of all sequences of all texts in their cells, those of one word before first; words by frequency, split as in ranked."""
    if b"" not in words:  # no text, or more frequent words than the ends
        return np.zeros(CELLS, np.float32)
    end = words.index(b"")
    sent = docs.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))

    def rows(at: np.ndarray, tables: list[bytes]) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(tables, pa.binary())], ["shard", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = sent.value, np.zeros(CELLS, np.int32)
        for _, _, flat, sizes in ranked(batches, known, split):
            one, two = cells_of(flat, np.cumsum(sizes) - sizes, end, len(known))
            np.add.at(total, one, total.dtype.type(1))  # a number of another type takes twenty times as long
            np.add.at(total, ONE * FINE + two, total.dtype.type(1))
        for i in range(0, CELLS, PIECE):
            if (piece := total[i : i + PIECE]).any():
                yield rows([i], [_narrow(piece)])

    def add(table: pa.Table) -> pa.Table:
        total = sum(_wide(x) for x in table.column("n").to_pylist())
        return pa.table({"shard": table.column("shard").slice(0, 1), "at": table.column("at").slice(0, 1), "n": pa.array([_narrow(total)], pa.binary())})

    schema = "shard int, at int, n binary"
    made = docs.select("text")
    shards, pieces = made.rdd.getNumPartitions(), made.mapInArrow(run, schema)
    while True:
        shards = math.ceil(shards / FAN)
        pieces = pieces.withColumn("shard", (F.col("shard") % max(1, shards)).cast("int")).groupBy("shard", "at").applyInArrow(add, schema)
        if shards <= 1:
            break
    out = np.zeros(CELLS, np.float32)
    for r in pieces.toLocalIterator():  # a fixed number of rows of fixed size
        out[r["at"] : r["at"] + PIECE] = _wide(r["n"])
    sent.destroy()
    return out


@dataclass
class Sequences:
    """Counts by cells, and the rank of a text's end among the words of the head."""

    counts: np.ndarray
    end: int
    shares: np.ndarray  # probabilities of the fine classes by the words' bytes, for each class of the gates: (classes, FINE)
    n_head: int

    def __getstate__(self) -> dict:
        return {"counts": zlib.compress(self.counts.tobytes(), 1), "end": self.end, "shares": self.shares, "n_head": self.n_head}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"counts": np.frombuffer(zlib.decompress(state["counts"]), np.float32)})
        self.__post_init__()

    def __post_init__(self):
        self.counts = np.asarray(self.counts, np.float32)
        self.one, self.two = self.counts[: ONE * FINE], self.counts[ONE * FINE :]
        table = self.one.reshape(ONE, FINE // COARSE, COARSE)
        self.coarse = table.sum(1, dtype=np.float64).astype(np.float32).ravel()
        self.one_all = self.coarse.reshape(ONE, COARSE).sum(1, dtype=np.float64)
        self.two_all = self.two.reshape(TWO, COARSE).sum(1, dtype=np.float64)
        self.shares = np.maximum(self.shares, 1e-12)
        self.shares = self.shares / self.shares.sum(1, keepdims=True)
        self.coarse_shares = self.shares.reshape(len(self.shares), FINE // COARSE, COARSE).sum(1)

    def gains(self, ranks: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """What knowing the words before adds to each token's log10 probability; kinds: the gate class of each token, learn: of each text."""
        if self.end < 0 or not len(sizes):
            return np.zeros(len(ranks))
        starts = np.cumsum(sizes) - sizes
        one, two = cells_of(ranks, starts, self.end, self.n_head)
        b1, fine, b2 = one // FINE, one % FINE, two // COARSE
        c = fine % COARSE
        n_f, n_c, n_1 = self.one[one].astype(np.float64), self.coarse[b1 * COARSE + c].astype(np.float64), self.one_all[b1]
        n_2, all_2 = self.two[two].astype(np.float64), self.two_all[b2]
        own = np.flatnonzero(np.repeat(learn, sizes))
        if len(own):
            text = np.repeat(np.arange(len(sizes)), sizes)[own]
            # One order serves all beginnings of a key.
            key = ((text * ONE + b1[own]) * COARSE + c[own]) * (FINE // COARSE) + fine[own] // COARSE
            for counts, less in zip((n_f, n_c, n_1), _times(key, (1, FINE // COARSE, FINE)), strict=True):
                counts[own] = np.maximum(counts[own] - less, 0)
            for counts, less in zip((n_2, all_2), _times(text * (TWO * COARSE) + two[own], (1, COARSE)), strict=True):
                counts[own] = np.maximum(counts[own] - less, 0)
        q_f, q_c = self.shares[kinds, fine], self.coarse_shares[kinds, c]
        logs = np.zeros((len(LEANS), len(ranks)))
        for e, (a, b) in enumerate(LEANS[1:], 1):
            p_f, p_c = n_f + a * q_f, (n_c + a * q_c)
            logs[e] = p_f / ((n_1 + a) * q_f)
            if b < WEAK:
                logs[e] *= (n_2 * (n_1 + a) / p_c + b) / (all_2 + b)
        np.log(logs[1:], out=logs[1:])
        run = np.cumsum(logs, 1)
        run -= np.repeat(run[:, starts] - logs[:, starts], sizes, 1)  # from each text's beginning
        top = run.max(0)
        run -= top
        mixed = top + np.log(TRUST @ np.exp(run, out=run))
        out = np.diff(mixed, prepend=0.0)
        out[starts] = mixed[starts]
        return out / np.log(10)


def _times(key: np.ndarray, spans: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each span, how often the key of each place occurs when divided by it."""
    order = np.argsort(key)
    key = key[order]
    for span in spans:
        whole = key // span
        first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
        n = np.diff(np.append(first, len(whole)))
        out = np.empty(len(key), np.int64)
        out[order] = np.repeat(n, n)
        yield out
