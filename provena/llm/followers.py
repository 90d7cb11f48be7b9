"""Words foretold by the one and the two words before them, for the context-mixing model.

The context of a token is the word before it, and the two words before it; a text begins after an end. For each context that
is frequent enough, training counts which words followed. Whether the next word is one of them is a bit of its own, for
each of the two contexts: its log odds are those of the context's occurrences against its different followers, moved by an
offset. Several pairs of offsets, one of which trusts no context, stand beside each other and are mixed by weights that
follow how well each has foretold the text so far, so that a text whose order tells nothing soon stops paying for it.

The share of a context's occurrences that its kept followers make up is left to them alone; what is not kept, and the bit's
other side, is left to the words' own probabilities, so that all words together have a probability of one. A training text is
foretold by what is left when its own occurrences are taken out.

Counts are exact, over the whole training part, for sequences of the commonest words. The most frequent sequences go to
every task, a fixed number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import blocks
from provena.llm.common import discard, materialize

PAIRED_BITS = 14
PAIRED = 1 << PAIRED_BITS  # commonest words whose sequences are counted
MOST = 1 << 19  # sequences that every task gets
LEAST = 3  # occurrences of such a sequence
TRIPLE = 1 << (3 * PAIRED_BITS)  # added to keys of three words
OFF = -np.inf
#: Offsets of the log odds of one and of two words before, and how much each pair is trusted at a text's beginning.
OFFSETS = np.array([(OFF, OFF), (-4.0, -2.0), (-3.0, 0.0), (-1.5, -1.0), (0.0, 1.0), (1.5, 2.0)])
TRUST = np.array([0.5, 0.1, 0.1, 0.1, 0.1, 0.1])
BUFFER = 1 << 20  # keys that a task counts at a time


def keys_of(ranks: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, key of two words, key of three words) of each token of texts that begin at starts; -1 where a word is not of the PAIRED.

    ranks: of the tokens, by frequency; end: that of a text's end.
    """
    before = np.empty_like(ranks)
    before[1:], before[starts] = ranks[:-1], end
    two = np.where((ranks < PAIRED) & (before < PAIRED), before << PAIRED_BITS | ranks, -1)
    last = np.full_like(two, -1)
    last[1:] = two[:-1]
    last[starts] = -1
    return before, two, np.where((last >= 0) & (ranks < PAIRED), TRIPLE + (last << PAIRED_BITS | ranks), -1)


def count(docs: DataFrame, words: list[bytes], split, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(keys ascending, counts) of the most frequent sequences of all texts, `most` at the utmost; words by frequency, split cuts a text."""
    rank = {w: i for i, w in enumerate(words[:PAIRED])}
    if b"" not in rank:  # no text, or more frequent words than the ends
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, held, size = sent.value, [], 0
        end = ranks[b""]

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

        for _, texts in blocks(batches):
            cut = [split(t) for t in texts]
            sizes = np.fromiter(map(len, cut), np.int64, len(cut)) + 1
            flat = np.fromiter((ranks.get(w, PAIRED) for ws in cut for w in (*ws, b"")), np.int64, int(sizes.sum()))
            _, two, three = keys_of(flat, np.cumsum(sizes) - sizes, end)
            both = np.concatenate([two[two >= 0], three[three >= 0]])
            held.append(both)
            size += len(both)
            if size >= BUFFER:
                yield flush()
                size = 0
        yield flush()

    counted = materialize(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST), "lm-sequences")
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 16 + 864)).cast("int")
    left, least = most, 1 << 30
    for r in sorted(counted.groupBy(step.alias("grade")).count().collect(), key=lambda r: -r["grade"]):  # under two thousand grades
        if r["count"] > left:
            break
        left, least = left - r["count"], r["grade"]
    table = counted.filter(step >= least).toArrow()
    discard(counted)
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


@dataclass
class Followers:
    """The kept sequences, ascending, with their counts, and the counts of single words; end: the rank of a text's end."""

    keys: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    end: int

    def __post_init__(self):
        self.words = self.words[:PAIRED].astype(np.float64)
        triple = self.keys >= TRIPLE
        pairs = int((~triple).sum())
        # How much followers make up of each context, and how many they are: of words, and of pairs by their place.
        first = self.keys[:pairs] >> PAIRED_BITS
        self.mass = [np.bincount(first, self.counts[:pairs], len(self.words))]
        self.kinds = [np.bincount(first, minlength=len(self.words)).astype(np.float64)]
        # A sequence is no more frequent than its beginning, which is therefore kept too.
        context = np.searchsorted(self.keys[:pairs], (self.keys[pairs:] - TRIPLE) >> PAIRED_BITS)
        self.mass.append(np.bincount(context, self.counts[pairs:], pairs))
        self.kinds.append(np.bincount(context, minlength=pairs).astype(np.float64))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def gains(self, ranks: np.ndarray, sizes: np.ndarray, own: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """What knowing the words before adds to each token's log10 probability; own: those without it, learn: of each text."""
        if not len(self.keys) or not len(sizes):
            return np.zeros(len(ranks))
        starts = np.cumsum(sizes) - sizes
        before, two, three = keys_of(ranks, starts, self.end)
        place = [self._place(two), self._place(three)]
        # A text of the training part is foretold by the others: of each word and sequence, its own occurrences.
        text = np.repeat(np.arange(len(sizes)), sizes)
        learnt = learn[text]

        def without_own(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
            out = np.where(at >= 0, counts[np.maximum(at, 0)], 0).astype(np.float64)
            some = np.flatnonzero((at >= 0) & learnt)
            _, inverse, times = np.unique(text[some] * np.int64(len(counts)) + at[some], return_inverse=True, return_counts=True)
            out[some] -= times[inverse]
            return out

        found = [without_own(p, self.counts) for p in place]
        # The context's own occurrences: of the word before, and of the pair that ends there.
        ended = np.full(len(ranks), -1)
        ended[1:] = place[0][:-1]
        ended[starts] = -1
        context = [np.where(before < len(self.words), before, -1), ended]
        single = without_own(np.where(ranks < len(self.words), ranks, -1), self.words)
        seen = [np.empty(len(ranks)), np.zeros(len(ranks))]
        seen[0][1:], seen[0][starts] = single[:-1], single[starts + sizes - 1]  # a text begins after an end
        seen[1][1:] = found[0][:-1]
        seen[1][starts] = 0
        odds, mass, share = [], [], []
        with np.errstate(divide="ignore", over="ignore"):
            even = 10**-own
            for k in (0, 1):
                total = np.where(context[k] >= 0, seen[k], 0)
                whole = (self.words, self.counts)[k][np.maximum(context[k], 0)]
                held = self.mass[k][np.maximum(context[k], 0)] / np.maximum(whole, 1) if len(self.mass[k]) else np.zeros(len(ranks))
                kinds = self.kinds[k][np.maximum(context[k], 0)] if len(self.kinds[k]) else np.zeros(len(ranks))
                known = (total > 0) & (held > 0)
                mass.append(np.where(known, np.minimum(held, 1), 0))
                odds.append(np.log(np.maximum(total * held, 1e-3) / (kinds + 1)))
                share.append(np.where(known, np.minimum(found[k] / np.maximum(total, 1), 1), 0))
            logs = np.empty((len(ranks), len(OFFSETS)))
            for e, (one, both) in enumerate(OFFSETS):
                p, q = 1 / (1 + np.exp(-(odds[0] + one))), 1 / (1 + np.exp(-(odds[1] + both)))
                by_one = 1 + p * (share[0] * even - mass[0])
                logs[:, e] = np.log(np.maximum((1 - q * mass[1]) * by_one + q * share[1] * even, 1e-12))
        run = np.cumsum(logs, 0)
        run -= np.repeat(run[starts] - logs[starts], sizes, 0)  # from each text's beginning
        top = run.max(1)
        mixed = top + np.log(np.exp(run - top[:, None]) @ TRUST)
        out = np.diff(mixed, prepend=0.0)
        out[starts] = mixed[starts]
        return out / np.log(10)
