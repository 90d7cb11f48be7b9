"""Online logistic context mixing: log probabilities of texts from hashed-context bit predictors.

A text is the sequence of its words and one end. Each token is coded byte by byte, each byte by the decisions of a
fixed prefix code, with a space closing every word; the end is a space at once. For each decision, several contexts -
the last one to four bytes of the word, and the word so far - are hashed together with a class to a counter of zeros
and ones seen in training. The counters' log odds are combined by weights that a gate selects by how much the
contexts have seen; weights are fitted online by gradient steps, and an adaptive table refines the mixed probability
by the byte before. A word's class is the one that best explains the words before it in its text, so that a text's
language selects its predictors; texts are scored without looking at any column but the text.

Between words, the one and the two words before tell which words may follow, by hashed counts of all such sequences in training,
mixed by weights that adapt within the text (`sequences`).

Above these stand phrases. A text is cut where the hash of two neighbouring words says so, into runs of about
sixteen words; a run that occurs in other training texts is foretold by its count. Whether the next run is such a one
is a bit of its own: counters by how the last runs went, which learn within the text, are mixed by weights that are
updated after each run. A run's probability is the sum of both ways, by phrase and by its words. A training text's own
runs are left out of the counts that it is scored by, so that what it shares with others tells, not that it was read.

Training needs counts of words by class, of sequences of words and of phrases only. They are exact, over the whole training part, and made by
shuffles that grow with it. Word counts are turned into tables of fixed size, shard by shard, and summed as a tree; the
weights are fitted by the same shards on all of their words, with each word's own occurrence taken out first. The
frequent words' costs go to every task; all other words are joined with the counts and coded where they meet.

The base score is the unigram model with one added to each count.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import parts
from provena.llm.common import doc_hash_remainder, materialize
from provena.llm.sequences import WIDE, Sequences, class_shares, ranked, words_in
from provena.llm.sequences import count as count_sequences

ORDERS = 5  # one to four bytes back, and the word so far
BITS = (18, 19, 20, 20, 21)  # table size of each context, as a power of two
BASES = np.cumsum([0, *(1 << b for b in BITS)])
SLOTS = int(BASES[-1])
PIECE = 1 << 15  # slots in a row when tables are summed
SHARD = 1_000_000  # counted words in a shard, about
FAN = 32  # shards whose tables one task sums
HEAD = 1 << 18  # words whose costs every task gets
CLASSES = 6  # classes of the gates: one for each of the most frequent languages, the first one for all others
CUT = 48  # bytes of a word that are coded together; a longer one goes on in further parts
GATES, REFINED = 24, 24
RATE = 0.05
SPACE = 0x20
PHRASE = 16  # words between two cuts, on average
LEAST_PHRASE = 4  # words of the shortest run that counts as a phrase
MEMO = 300_000
COUNTED = 40_000_000  # bytes of words that are counted at a time
PREFIX_GRADES, MIDDLE_GRADES = (0.5, 1.5, 3.5, 15.5, 255.5), (0.5, 3.5, 31.5)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_POWERS = np.cumprod(np.full(CUT + 2, _M[0]), dtype=np.uint64)


def tokens_of(text: str) -> list[bytes]:
    """Words of the text with ASCII letters lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Code:
    """A prefix code for bytes: each byte's path of (node, decision), in flat arrays."""

    def __init__(self, weights: np.ndarray):
        heap = [(float(w) + 1, s, s) for s, w in enumerate(weights)]
        heapq.heapify(heap)
        above, number = {}, 256
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x], above[y] = (number, 0), (number, 1)
            heapq.heappush(heap, (a + b, number, number))
            number += 1
        nodes, bits, sizes = [], [], []
        for s in range(256):
            path, at = [], s
            while at in above:
                at, bit = above[at]
                path.append((at - 256, bit))
            nodes += [n for n, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            sizes.append(len(path))
        self.nodes, self.bits = np.array(nodes, np.uint64), np.array(bits, np.uint8)
        self.size = np.array(sizes)
        self.start = np.cumsum(self.size) - self.size


def cut(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words with their closing spaces, in parts of at most CUT bytes, and the word that each part is of.

    A part is coded without the bytes before it. As every part but the last one is full, the parts tell the word.
    """
    if all(len(w) < CUT for w in words):
        return [w + b" " for w in words], np.arange(len(words))
    parts = [[x[j : j + CUT] for j in range(0, len(x), CUT)] for x in (w + b" " for w in words)]
    return [p for ps in parts for p in ps], np.repeat(np.arange(len(words)), [len(ps) for ps in parts])


def events(parts: list[bytes], classes: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every decision in these parts of words: its part, slots (decisions, ORDERS), bit, byte before."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    wide = flat.astype(np.uint64)
    back = []
    for k in range(1, 5):
        b = np.full(len(flat), SPACE, np.uint64)
        b[k:] = wide[:-k]
        back.append(np.where(place >= k, b, np.uint64(SPACE)))
    total = np.cumsum((wide + np.uint64(1)) * _POWERS[place], dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), total[:-1]])
    so_far = before - before[np.arange(len(flat)) - place]
    low, contexts = back[0], [back[0]]
    for k in range(1, 4):
        low = low | back[k] << np.uint64(8 * k)
        contexts.append(low)
    contexts.append(so_far + place.astype(np.uint64) * _M[3])
    paths = code.size[flat]
    rep = np.repeat(np.arange(len(flat)), paths)
    step = np.arange(len(rep)) - np.repeat(np.cumsum(paths) - paths, paths) + code.start[flat][rep]
    node, kind = code.nodes[step] * _M[4], classes[owner].astype(np.uint64)
    slots = np.empty((len(rep), ORDERS), np.int64)
    for k in range(ORDERS):
        h = (contexts[k] * _M[0] + kind * _M[3] + np.uint64(k)) * _M[1]
        h = ((h ^ h >> np.uint64(29))[rep] + node) * _M[2]
        slots[:, k] = ((h ^ h >> np.uint64(32)) * _M[1] >> np.uint64(64 - BITS[k])).astype(np.int64) + BASES[k]
    return owner[rep], slots, code.bits[step], back[0].astype(np.int64)[rep]


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + n1.dtype.type(0.4)) / (n0 + n0.dtype.type(0.4)))


def graded(seen: np.ndarray, grades: tuple[float, ...]) -> np.ndarray:
    """How many of the grades each count has passed."""
    return sum((seen > t).astype(np.uint8) for t in grades)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def grade(mixed: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((mixed + 9) * (REFINED / 18)), 0, REFINED - 1).astype(np.int64)


@dataclass
class Head:
    """The frequent words with their counts in all and by class (words, CLASSES), most frequent first."""

    words: list[bytes]
    counts: np.ndarray
    totals: np.ndarray  # tokens of each class
    code: Code = field(init=False)

    def __post_init__(self):
        n = self.counts.sum(1)
        seen = np.zeros(256)
        for w, k in zip(self.words, n.tolist(), strict=True):
            for b in w:
                seen[b] += k
            seen[SPACE] += k
        self.code = Code(seen)

    def leanings(self) -> np.ndarray:
        """How much each word speaks for each class: its log probability there."""
        return np.log((self.counts + 0.2) / (self.totals + 0.2 * len(self.words) + 1)).astype(np.float32)


def by_class(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words in parts, classes, counts) of a batch of counted words, a few thousand at a time."""
    for i in range(0, batch.num_rows, 8192):
        some = batch.slice(i, 8192)
        words = some.column("word").to_pylist()
        n = np.stack([some.column(f"k{k}").to_numpy() for k in range(CLASSES)], 1).astype(np.float64)
        at, k = np.nonzero(n)
        parts, owner = cut([words[j] for j in at])
        if parts:
            yield parts, k[owner], n[at, k][owner]


def add_counts(out: np.ndarray, words: list[bytes], classes: np.ndarray, n: np.ndarray, code: Code) -> None:
    """Add these counted parts of words to the counts of zeros and ones in every slot, exact up to 2^53."""
    owner, slots, bits, _ = events(words, classes, code)
    w, at = n[owner], slots * 2 + bits[:, None]
    for k in range(ORDERS):
        np.add.at(out, at[:, k], w)


class Fit:
    """Mixing weights and refinement counts, fitted online over blocks of words."""

    def __init__(self):
        self.weights = np.full((GATES, ORDERS), 0.3)
        self.refined = np.zeros((256 * REFINED, 2))
        self.slope = np.full((GATES, ORDERS), 1e-3)  # summed squares of steps, to scale the rate

    def update(self, words: list[bytes], classes: np.ndarray, n: np.ndarray, tables: np.ndarray, code: Code) -> None:
        """tables: counts as float32, shape (SLOTS, 2)."""
        owner, s, bits, before = events(words, classes, code)
        y = bits.astype(np.float32)[:, None]
        counts = tables.view(np.complex64).ravel().take(s).view(np.float32).reshape(*s.shape, 2)  # a pair is one element to take
        # Take out one occurrence of the word itself.
        n0, n1 = np.maximum(counts[:, :, 0] - (1 - y), 0), np.maximum(counts[:, :, 1] - y, 0)
        x = log_odds(n0, n1)
        g = graded(n0[:, 4] + n1[:, 4], PREFIX_GRADES) * 4 + graded(n0[:, 2] + n1[:, 2], MIDDLE_GRADES)
        w = (n**0.75)[owner]
        mixed = np.einsum("ij,ij->i", x, self.weights.astype(np.float32).take(g, 0))
        err = (y[:, 0] - squash(mixed)) * w
        total = np.bincount(g, w, GATES) + 1e-9
        step = np.stack([np.bincount(g, err * x[:, k], GATES) for k in range(ORDERS)], 1) / total[:, None]
        self.slope += step**2
        self.weights += RATE * step / np.sqrt(self.slope)
        at = (before * REFINED + grade(mixed)) * 2 + bits
        self.refined += np.bincount(at, w, self.refined.size).reshape(-1, 2)


class Coder:
    """The fitted bit model: log odds and use of every slot, weights and refinement table."""

    def __init__(self, tables: np.ndarray, weights: np.ndarray, refined: np.ndarray, code: Code):
        self.odds = log_odds(tables[:, 0], tables[:, 1]).astype(np.float32)
        seen = tables.sum(1)
        self.prefix, self.middle = graded(seen[BASES[4] :], PREFIX_GRADES) * 4, graded(seen[BASES[2] : BASES[3]], MIDDLE_GRADES)
        self.weights = weights.astype(np.float32)
        # The refined odds lean on the mixed ones where little was seen.
        centre = (np.arange(REFINED) + 0.5) * (18 / REFINED) - 9
        self.refined = ((refined[:, 1] + 8 * np.tile(squash(centre), 256)) / (refined.sum(1) + 8)).astype(np.float32)
        self.code = code

    def costs(self, words: list[bytes], classes: np.ndarray) -> np.ndarray:
        """log10 probability of each word, with its closing space, in its class."""
        out = np.zeros(len(words))
        for i in range(0, len(words), 8192):
            parts, of = cut(words[i : i + 8192])
            owner, s, y, before = events(parts, classes[i : i + 8192][of], self.code)
            g = self.prefix.take(s[:, 4] - BASES[4]) + self.middle.take(s[:, 2] - BASES[2])
            mixed = np.einsum("ij,ij->i", self.odds.take(s), self.weights.take(g, 0))
            p1 = np.clip((squash(mixed) + self.refined.take(before * REFINED + grade(mixed))) / 2, 1e-6, 1 - 1e-6)
            bits = np.log10(np.where(y > 0, p1, 1 - p1))
            out[i : i + 8192] = np.bincount(of[owner], bits, len(words[i : i + 8192]))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M[1]
    x = (x ^ x >> np.uint64(27)) * _M[2]
    return x ^ x >> np.uint64(31)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word's bytes; 0 bytes hash to that of nothing."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        flat, starts = np.frombuffer(b"".join(words), np.uint8), (np.cumsum(size) - size)[some]
        place = np.arange(len(flat)) - np.repeat(starts, size[some])
        powers = np.cumprod(np.full(int(size.max()) + 1, _M[0]), dtype=np.uint64)
        out[some] = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * powers[place], starts)
    return _mix(out + size.astype(np.uint64) * _M[3])


def phrases(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys, words) of the runs between cuts, given the words' hashes and whether each opens a text.

    A cut follows a word where the hash of it and the one before says so, so that equal passages are cut alike.
    """
    pair = _mix(np.concatenate([np.zeros(1, np.uint64), tokens[:-1]]) * _M[0] + tokens)
    ends = (pair % np.uint64(PHRASE) == 0) & ~first
    starts = np.flatnonzero(first | np.concatenate([[False], ends[:-1]]))
    size = np.diff(np.append(starts, len(tokens)))
    place = np.arange(len(tokens)) - np.repeat(starts, size)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, _M[0]), dtype=np.uint64)
    keys = _mix(np.add.reduceat(_mix(tokens) * powers[place], starts)) if len(starts) else np.zeros(0, np.uint64)
    return starts, keys.view(np.int64), size


class Scorer:
    """What every task needs to split texts: the frequent words with their costs by class, counts, leanings and sequences."""

    def __init__(self, head: Head, costs: np.ndarray, counts: np.ndarray):
        self.sequences = Sequences(counts, head.words.index(b"") if b"" in head.words else -1, class_shares(costs), len(head.words))
        self.n_head = len(head.words)
        self.words = pa.array(head.words, pa.binary())
        self.costs = np.concatenate([costs, np.zeros((1, CLASSES), np.float32)])
        self.leaning = np.ascontiguousarray(np.concatenate([head.leanings(), np.zeros((1, CLASSES), np.float32)]).T)
        self.hashes = np.append(word_hashes(head.words), np.uint64(0))
        self.base = np.concatenate([np.log10(head.counts.sum(1) + 1), [0.0]])
        self.prior = np.log((head.totals + 1e-9) / (head.totals.sum() + 1))  # an empty class is never taken

    def split(self, texts: pa.Array, words: pa.Array, ranks: np.ndarray, sizes: np.ndarray, learn: np.ndarray) -> list[pa.Array]:
        """Of each text, of which learn says whether it is of the training part: tokens, those of the head, base sum, the end's cost, bytes, phrase keys and costs of its runs, other words.

        words, ranks and sizes: as ranked gives them for these texts.
        """
        starts = np.cumsum(sizes) - sizes
        held = ranks < self.n_head
        out = np.flatnonzero(~held)
        # An end that is not of the head is the word after all others.
        place = np.arange(len(ranks)) - np.repeat(np.arange(len(sizes)), sizes)
        place[starts + sizes - 1] = len(words)
        others = (pa.concat_arrays([words, pa.array([b""], pa.binary())]) if not held[starts + sizes - 1].all() else words).take(pa.array(place[out]))
        # The class that best explains the words before: running sums within each text.
        best, kind = np.full(len(ranks), -np.inf), np.zeros(len(ranks), np.int64)
        for k in range(CLASSES):
            lean = self.leaning[k].take(ranks).astype(np.float64)
            run = np.cumsum(lean) - lean
            run -= np.repeat(run[starts], sizes)
            run += self.prior[k]
            kind[run > best] = k
            np.maximum(run, best, out=best)
        cost = self.costs[ranks, kind].astype(np.float64)
        cost += self.sequences.gains(ranks, sizes, kind, learn)
        # Runs of words; the end stands alone, after them.
        ends = starts + sizes - 1
        is_word = np.ones(len(ranks), bool)
        is_word[ends] = False
        first = np.zeros(len(ranks), bool)
        first[starts] = True
        hashes = self.hashes.take(ranks)
        hashes[out] = word_hashes(others.to_pylist())
        at, keys, n = phrases(hashes[is_word], first[is_word])
        keys = np.where(n >= LEAST_PHRASE, keys, 0)
        place = np.flatnonzero(is_word)[at]  # of each run's first word among all tokens
        run_ends = np.append(0, np.searchsorted(place, starts + sizes))
        lows = np.add.reduceat(cost[is_word], at) if len(at) else np.zeros(0)
        # Words that are not of the head are coded elsewhere; the run that each is of goes with it, -1 for an end.
        of_text = np.searchsorted(starts, out, "right") - 1
        local = np.where(is_word[out], np.searchsorted(place, out, "right") - 1 - run_ends[of_text], -1)
        rest = pa.StructArray.from_arrays([others, pa.array(kind[out], pa.int32()), pa.array(local, pa.int32())], ["word", "kind", "at"])
        rest_ends = np.append(0, np.searchsorted(out, starts + sizes))
        lists = lambda ends_, values: pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), values)
        sums = lambda x: np.add.reduceat(x, starts)
        return [
            pa.array(sizes), pa.array(sums(held.astype(np.int64))), pa.array(sums(self.base[ranks])), pa.array(cost[ends]), pc.binary_length(texts).fill_null(0).cast(pa.int64()),
            lists(run_ends, pa.array(keys, pa.int64())), lists(run_ends, pa.array(lows, pa.float64())), lists(rest_ends, rest),
        ]


class RunMixer:
    """Whether the next run of a text is one that other texts hold: a bit foretold by how its last runs went.

    Three counters, by one, two and four of the last bits, learn within the text; their log odds and a bias are mixed
    by weights, gated by the last bit, that follow the error after each run.
    """

    def __init__(self):
        # A first belief: as the run before.
        self.zeros = [[0.5 if c & 1 else 4.0 for c in range(n)] for n in (2, 4, 16)]
        self.ones = [[0.5 * last if c & 1 else 0.25 for c in range(n)] for n, last in ((2, 1), (4, 2), (16, 4))]
        self.weights = [[0.3, 0.3, 0.3, 0.1] for _ in range(2)]
        self.past = 0

    def predict(self) -> float:
        past, (a, b, c), (d, e, f) = self.past, self.zeros, self.ones
        x = self.inputs = (math.log((d[past & 1] + 0.05) / (a[past & 1] + 0.05)), math.log((e[past & 3] + 0.05) / (b[past & 3] + 0.05)), math.log((f[past] + 0.05) / (c[past] + 0.05)), -1.0)
        w = self.weights[past & 1]
        self.p = min(max(1 / (1 + math.exp(-(w[0] * x[0] + w[1] * x[1] + w[2] * x[2] + w[3] * x[3]))), 1e-4), 1 - 1e-4)
        return self.p

    def update(self, share: float) -> None:
        """share: how much of the run's probability the phrase has given."""
        w, step = self.weights[self.past & 1], 0.02 * (share - self.p)
        for k, x in enumerate(self.inputs):
            w[k] += step * x
        for k, mask in enumerate((1, 3, 15)):
            self.zeros[k][self.past & mask] += 1 - share
            self.ones[k][self.past & mask] += share
        self.past = (self.past << 1 | (share > 0.5)) & 15


_ALONE, _ALONE_MIXER = [0.0], RunMixer()  # the cost of the bits of a text whose first runs no other holds


def alone(n: int) -> float:
    while len(_ALONE) <= n:
        _ALONE.append(_ALONE[-1] + math.log10(1 - _ALONE_MIXER.predict()))
        _ALONE_MIXER.update(0.0)
    return _ALONE[n]


def text_score(lows: list[float], found: dict[int, float], n_phrases: int) -> float:
    """log10 probability of a text's runs: lows by bytes, found: counts in other texts by place."""
    if not any(n > 0 for n in found.values()):
        return sum(lows) + alone(len(lows))
    mixer, total = RunMixer(), 0.0
    for i, low in enumerate(lows):
        p, n = mixer.predict(), found.get(i, 0.0)
        whole, share = math.log10(1 - p) + low, 0.0
        if n > 0:
            by_phrase = math.log10(p * n / n_phrases)
            top, less = max(whole, by_phrase), min(whole, by_phrase)
            whole = top + math.log10(1 + 10 ** max(less - top, -300))
            share = 10 ** max(by_phrase - whole, -300)
        total += whole
        mixer.update(share)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, n) of texts of some tens of megabytes at a time."""
    words: list[list[pa.Array]] = [[] for _ in range(CLASSES)]
    ends, size = np.zeros(CLASSES, np.int64), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for k, arrays in enumerate(words):
            if ends[k]:
                found = pc.value_counts(pa.chunked_array(arrays, pa.binary()))
                n = len(found) + 1
                word = pa.concat_arrays([found.field("values"), pa.array([b""], pa.binary())])
                yield pa.RecordBatch.from_arrays([word, pa.array(np.full(n, k, np.int32)), pa.array(np.append(found.field("counts").to_numpy(), ends[k]))], ["word", "kind", "n"])
            arrays.clear()
        ends[:] = 0

    for part in parts(batches, most=WIDE):
        found, n = words_in(part.column("text"))
        kinds = part.column("kind").to_numpy()
        of = np.repeat(kinds, n)
        for k in np.unique(kinds).tolist():
            words[k].append(found.filter(pa.array(of == k)))
        ends += np.bincount(kinds, minlength=CLASSES)
        size += found.nbytes
        if size > COUNTED:
            yield from flush()
            size = 0
    yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n, k0..) over all texts, in all and by class, with the ends under the empty word; stored once."""
    made = docs.select("text", "kind").mapInArrow(_count, "word binary, kind int, n long")
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(CLASSES)]
    return materialize(made.groupBy("word").agg(F.sum("n").alias("n"), *kinds), "lm-words")


def _counts_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(f"k{k}").to_numpy() for k in range(CLASSES)], 1)


def head_of(counts: DataFrame, totals: np.ndarray) -> tuple[Head, Column]:
    """The most frequent words, HEAD at the utmost, and the condition that tells them; words of one grade of counts stay or go together."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 16 + 864)).cast("int")
    grades = counts.groupBy(step.alias("grade")).count().collect()  # under two thousand grades
    left, least = HEAD, 1 << 30
    for r in sorted(grades, key=lambda r: -r["grade"]):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["grade"]
    table = counts.filter(step >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Head(table.column("word").to_pylist(), _counts_of(table), totals), step >= least


def _summed(pieces: DataFrame, shards: int, kind: type = np.float64) -> DataFrame:
    """Sums, of this kind, of the pieces (shard, at, sums) of equal place, over FAN shards at a time, so that no task gathers more."""

    def adder(kind: type):
        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
            return pa.table({"shard": table.column("shard").slice(0, 1), "at": table.column("at").slice(0, 1), "sums": pa.array([total.astype(kind).tobytes()], pa.binary())})

        return add

    while True:
        shards = math.ceil(shards / FAN)
        by = pieces.withColumn("shard", (F.col("shard") % shards).cast("int")).groupBy("shard", "at")
        pieces = by.applyInArrow(adder(kind if shards <= 1 else np.float64), "shard int, at int, sums binary")
        if shards <= 1:
            return pieces


def train(counts: DataFrame, n_words: int, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables, weights, refinement counts) of the counted words, all of fixed size."""
    spark = counts.sparkSession
    code = spark.sparkContext.broadcast(head.code)
    sharded = counts.coalesce(max(1, math.ceil(n_words / SHARD)))
    shards = sharded.rdd.getNumPartitions()
    schema = "shard int, at int, sums binary"

    def rows(places: list[int], sums: list[bytes]) -> pa.RecordBatch:
        shard = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(places), pa.int32()), pa.array(places, pa.int32()), pa.array(sums, pa.binary())], ["shard", "at", "sums"])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * 2)
        for batch in batches:
            for words, classes, n in by_class(batch):
                add_counts(total, words, classes, n, code.value)
        for i in range(0, len(total), 2 * PIECE):
            if (piece := total[i : i + 2 * PIECE]).any():
                yield rows([i], [piece.tobytes()])

    model = np.zeros(SLOTS * 2, np.float32)
    for r in _summed(sharded.mapInArrow(tables, schema), shards, np.float32).toLocalIterator():  # a fixed number of rows of fixed size
        piece = np.frombuffer(r["sums"], np.float32)
        model[r["at"] : r["at"] + len(piece)] = piece
    model = model.reshape(SLOTS, 2)
    sent = spark.sparkContext.broadcast(model)

    def mixers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, seen = Fit(), 0
        for batch in batches:
            for words, classes, n in by_class(batch):
                for i in range(0, len(words), 1024):
                    fit.update(words[i : i + 1024], classes[i : i + 1024], n[i : i + 1024], sent.value, code.value)
            seen += batch.num_rows
        if seen:
            yield rows([0], [np.concatenate([[seen], seen * fit.weights.ravel(), fit.refined.ravel()]).tobytes()])

    # Each task makes an online pass over its words; weights are averaged by words, refinement counts summed.
    fitted = _summed(sharded.mapInArrow(mixers, schema), shards).collect()
    sent.destroy()  # the driver's copy too
    total = np.frombuffer(fitted[0]["sums"], np.float64) if fitted else np.zeros(1 + GATES * ORDERS + 2 * 256 * REFINED)
    weights = total[1 : 1 + GATES * ORDERS].reshape(GATES, ORDERS)
    return model, weights / total[0] if total[0] else np.full((GATES, ORDERS), 0.3), total[1 + GATES * ORDERS :].reshape(-1, 2)


def head_costs(counts: DataFrame, in_head: Column, head: Head, sent) -> np.ndarray:
    """Costs of the frequent words in every class, shape (words, CLASSES), made by tasks and gathered: a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            made = np.stack([sent.value.costs(words, np.full(len(words), k)) if head_totals[k] else np.zeros(len(words)) for k in range(CLASSES)], 1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([r.tobytes() for r in made.astype(np.float32)], pa.binary())], ["word", "costs"])

    head_totals = head.totals
    table = counts.filter(in_head).select("word").mapInArrow(run, "word binary, costs binary").toArrow().sort_by("word")
    made = np.concatenate([np.frombuffer(c.buffers()[2], np.float32, len(c) * CLASSES, c.offset * CLASSES * 4) for c in table.column("costs").chunks] or [np.zeros(0, np.float32)])
    del table
    out = np.empty_like(made).reshape(-1, CLASSES)
    out[np.argsort(np.array(head.words, object), kind="stable")] = made.reshape(-1, CLASSES)  # words by bytes, as Arrow sorts them
    return out


REST = "array<struct<word:binary,kind:int,at:int>>"
SPLIT = f"doc_id long, learn boolean, uid long, n_tokens long, n_known long, base double, last double, n_bytes long, keys array<long>, lows array<double>, rest {REST}"


def _split(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, part, row = sent.value, TaskContext.get().partitionId() << 33, 0  # the value stays from task to task
    names = ["doc_id", "learn", "uid", "n_tokens", "n_known", "base", "last", "n_bytes", "keys", "lows", "rest"]
    for batch, words, ranks, sizes in ranked(batches, model.words):
        uid = pa.array(np.arange(part + row, part + row + batch.num_rows))
        row += batch.num_rows
        made = model.split(batch.column("text"), words, ranks, sizes, batch.column("learn").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learn"), uid, *made], names)


def _code(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost of each word in its class; rows of a word meet in one task, which codes it once."""
    memo: dict[tuple[bytes, int], float] = {}
    for batch in batches:
        keys = list(zip(batch.column("word").to_pylist(), batch.column("kind").to_pylist(), strict=True))
        new = list({k for k in keys if k not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set(keys))
        memo.update(zip(new, sent.value.costs([w for w, _ in new], np.array([k for _, k in new], np.int64)).tolist(), strict=True))
        cost = pa.array([memo[k] for k in keys], pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("at"), batch.column("n"), cost], ["uid", "at", "n", "cost"])


def _join(n_phrases: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The score of each text from its runs, the costs of its other words, and the phrases that other texts hold."""
    for batch in batches:
        n_rows, numpy = batch.num_rows, lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        lists = lambda c: (batch.column(c).flatten(), pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False))  # noqa: B023, E731
        low, n_runs = lists("lows")
        lows, run_at = low.to_numpy(zero_copy_only=False).copy(), np.cumsum(n_runs) - n_runs
        coded, n_coded = lists("coded")
        owner = np.repeat(np.arange(n_rows), n_coded)
        at, n, cost = (coded.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "cost"))
        in_run = at >= 0
        np.add.at(lows, run_at[owner[in_run]] + at[in_run], cost[in_run])
        known = n >= 0  # -1 where training lacks the word
        last = numpy("last") + np.bincount(owner[~in_run], cost[~in_run], n_rows)
        base = numpy("base") + np.bincount(owner[known], np.log10(n[known] + 1.0), n_rows)
        n_known = numpy("n_known") + np.bincount(owner[known], minlength=n_rows)
        scores = last + np.bincount(np.repeat(np.arange(n_rows), n_runs), lows, n_rows) + np.array([alone(k) for k in n_runs.tolist()])
        learn = numpy("learn")
        for i, met in enumerate(batch.column("met").to_pylist()):
            if met:
                own = Counter(x["key"] for x in met) if learn[i] else Counter()
                found = {x["at"]: float(x["n"] - own[x["key"]]) for x in met}
                scores[i] = last[i] + text_score(lows[run_at[i] : run_at[i] + n_runs[i]].tolist(), found, n_phrases)
        cols = [batch.column("doc_id"), batch.column("n_tokens"), pa.array(n_known, pa.int64()), pa.array(base), pa.array(scores), batch.column("n_bytes")]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base", "score", "n_bytes"])


def score(docs: DataFrame, trained_on: Column, key: str = "doc_id", text: str = "text", kind: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    trained_on selects the rows to learn from. kind names the column whose most frequent values in those rows are
    the classes; a missing column or null values give one class for all others. Null and empty texts are one end
    token; repeated rows count and are scored each, every one by the phrases of the others; a null id stays null;
    other columns are ignored. With nothing to learn from, every decision is even; no documents give no rows. bits_per_byte is null for an empty
    text. A text of any length is one row; runs, and parts of long words, have no length limit that drops any.
    """
    spark = docs.sparkSession
    shown = F.col(kind).cast("string") if kind in docs.columns else F.lit(None).cast("string")
    both = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), shown.alias("kind"), F.coalesce(trained_on, F.lit(False)).alias("learn"))
    common = both.filter("learn and kind is not null").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(CLASSES - 1).collect()
    numbered = F.lit(0)
    for i, r in enumerate(common):
        numbered = F.when(F.col("kind") == r["kind"], i + 1).otherwise(numbered)
    counts = word_counts(both.filter("learn").select("text", F.coalesce(numbered, F.lit(0)).alias("kind")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *(f"k{k}" for k in range(CLASSES)))]
    total = counts.agg(*sums, F.count("*").alias("v")).first()
    head, in_head = head_of(counts, np.array([total[f"k{k}"] for k in range(CLASSES)]))
    coder = spark.sparkContext.broadcast(Coder(*train(counts, total["v"], head), head.code))
    sequences = count_sequences(both.filter("learn"), head.words)
    scorer = spark.sparkContext.broadcast(Scorer(head, head_costs(counts, in_head, head, coder), sequences))
    made = materialize(both.select("doc_id", "text", "learn").mapInArrow(lambda it: _split(scorer, it), SPLIT), "lm-split")
    # Phrases that occur more than once, with their counts in training.
    runs = made.select("uid", "learn", F.posexplode("keys").alias("at", "key")).filter("key <> 0")
    held = materialize(runs.groupBy("key").agg(F.count_if("learn").alias("n"), F.count("*").alias("m")).filter("m > 1 and n > 0").select("key", "n"), "lm-phrases")
    n_phrases = made.filter("learn").agg(F.coalesce(F.sum(F.size(F.filter("keys", lambda k: k != 0))), F.lit(0))).first()[0]
    met = runs.select("uid", "at", "key").join(held, "key")
    met = met.groupBy("uid").agg(F.collect_list(F.struct("at", "key", "n")).alias("met"))  # no more than a text's own runs
    rest = made.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.kind", "r.at")
    coded = rest.join(counts.select("word", "n"), "word", "left").select("uid", "word", "kind", "at", "n")
    coded = coded.mapInArrow(lambda it: _code(coder, it), "uid long, at int, n long, cost double")
    coded = coded.groupBy("uid").agg(F.collect_list(F.struct("at", F.coalesce("n", F.lit(-1)).alias("n"), "cost")).alias("coded"))  # no more than a text's own words
    own = made.select("uid", "doc_id", "learn", "n_tokens", "n_known", "base", "last", "n_bytes", "lows")
    whole = own.join(met, "uid", "left").join(coded, "uid", "left")
    scored = whole.mapInArrow(lambda it: _join(max(1, n_phrases), it), "doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long")
    per_token = math.log10(total["n"] + total["v"] + 1)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(doc_hash_remainder(doc_id, modulus) == remainder, F.lit(False))
