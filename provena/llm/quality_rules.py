"""Quality rules: repetition and length, then the divergence from the languages of the corpus.

References are made from all documents: for each language the mean histogram of character classes, every document
weighing the same, and the shares of its most common words, marks by themselves left out. A document's own two histograms
are compared with each reference by Jensen-Shannon distance (the root of the divergence to base 2, from 0 to 1).

Limits come from the references and the corpus, not from labels. By words, a document is rejected where it is nearly as
far from every reference as a text without any of its common words is, and holds next to none of them. By characters, it is rejected where even the
nearest language is far outside the distances of the documents near to that language: beyond their median by many times
their spread. Short documents are not judged by histograms that say little about them, nor is a document of a language
with too few documents for a mean to say much: such a language has no reference.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provena.llm.bpe import blocks
from provena.llm.common import materialize, numbered_words, worker_memo

LEAST_DOCS = 20  # documents with text from which a language has a reference, whatever its share
COMMON = 200  # words of a reference
CHAR_GUARD, WORD_GUARD = 100, 50  # least code points and words for the two comparisons
WORD_LIMIT = 0.99  # of the distance of a text without common words
FEW = 0.1  # of the share of common words that a language has: a document with more of them has some
SPREADS, LEAST_SPREAD = 10.0, 0.01  # spreads beyond the median from which a document is far by characters
WINDOW = 8  # words in a repeated passage
SPACE, SYMBOL = 0, 1
CLASSES = 9


@cache
def class_table() -> np.ndarray:
    """Class of each code point below U+10000: white space, symbols, lower, upper, other letters, digits, stops, other marks, rest."""
    out = np.full(1 << 16, 8, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if kind == "Ll":
            out[c] = 2
        elif kind == "Lu":
            out[c] = 3
        elif kind[0] in "LM":
            out[c] = 4
        elif kind[0] == "N":
            out[c] = 5
        elif kind[0] in "PS":
            out[c] = 7
    for c in ".,;:!?'\"-()":
        out[ord(c)] = 6
    for c in "#*$%&|<>":
        out[ord(c)] = SYMBOL
    out[[32, *range(9, 14)]] = SPACE
    return out


def character_classes(texts: list[str]) -> np.ndarray:
    """Code points of each class in each text, shape (texts, CLASSES)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = class_table()[np.minimum(codes, 0xFFFF)]
    owner = np.repeat(np.arange(len(texts)) * CLASSES, [len(t) for t in texts])
    return np.bincount(owner + kinds, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)


def repeated_words(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of each text in windows of WINDOW words that occur at least twice in it.

    Windows get exact numbers by doubling: pairs of words, pairs of pairs, pairs of those.
    """
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    number, width = flat, 1
    while width < WINDOW:
        if len(number) <= width:
            return np.zeros(len(sizes), np.int64)
        joined = number[:-width] * (int(number.max()) + 1) + number[width:]
        number, width = np.unique(joined, return_inverse=True)[1], 2 * width
    n = len(flat) - WINDOW + 1
    at = np.flatnonzero(np.arange(n) + WINDOW <= ends[owner[:n]])
    key = owner[at] * (int(number.max(initial=0)) + 1) + number[at]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[times[inverse] > 1]
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    return np.bincount(owner, np.cumsum(change)[:-1] > 0, len(sizes)).astype(np.int64)


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


class Base(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


def distance(own: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of own from the reference, both of shares."""
    middle = (own + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(own > 0, own * np.log2(own / middle), 0).sum(1)
        b = np.where(reference > 0, reference * np.log2(reference / middle), 0).sum(1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


class References(NamedTuple):
    """chars (languages, CLASSES), shares (languages, COMMON + 1) with all other words last, the words' places, the languages."""

    chars: np.ndarray
    shares: np.ndarray
    places: dict[bytes, list[tuple[int, int]]]
    names: list[str]

    @property
    def without_common(self) -> np.ndarray:
        """The distance of a text without any common word from each reference."""
        return np.array([distance(np.eye(COMMON + 1)[COMMON:], s)[0] for s in self.shares])

    @classmethod
    def of(cls, chars: dict[str, np.ndarray], words: dict[str, list[tuple[bytes, float]]]) -> References:
        names = sorted(chars)
        shares = np.zeros((len(names), COMMON + 1))
        places: dict[bytes, list[tuple[int, int]]] = {}
        for i, name in enumerate(names):
            for j, (w, share) in enumerate(words.get(name, [])):
                shares[i, j] = share
                places.setdefault(w, []).append((i, j))
            shares[i, COMMON] = max(0.0, 1 - shares[i].sum())
        return cls(np.array([chars[n] for n in names]).reshape(-1, CLASSES), shares, places, names)


class Measured(NamedTuple):
    """Of each text: base counts, distance by characters and its language, distance by words, and that one's share of the farthest; NaN where guarded."""

    base: Base
    by_char: np.ndarray
    near: list[str | None]
    by_word: np.ndarray
    word_share: np.ndarray


def measure(texts: list[str], langs: list[str | None], refs: References) -> Measured:
    words, flat, sizes, raw = numbered_words(texts)
    chars = character_classes(texts)
    base = Base(sizes, chars.sum(1) - chars[:, SPACE], chars[:, SYMBOL], np.array([duplicate_lines(r) for r in raw], np.int64), repeated_words(flat, sizes))
    by_char, by_word, word_share, near = (np.full(len(texts), np.nan) for _ in range(4))
    owner = np.repeat(np.arange(len(texts)), sizes)
    named = set(refs.names)
    judged = np.fromiter((k is None or k in named for k in langs), bool, len(texts))
    long_, wordy = judged & (chars.sum(1) >= CHAR_GUARD), judged & (sizes >= WORD_GUARD)
    own_chars = chars / np.maximum(1, chars.sum(1, keepdims=True))
    lower = [w.lower() if w.isascii() else w.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for w in words]
    common: list[list[tuple[int, int]]] = [[] for _ in refs.chars]
    for n, w in enumerate(lower):
        for lang, j in refs.places.get(w, ()):
            common[lang].append((n, j))
    farthest = np.maximum(refs.without_common, 1e-9) if len(refs.names) else np.zeros(0)
    for i in range(len(refs.chars)):
        here = distance(own_chars, refs.chars[i])
        near = np.where(long_ & ~(here >= by_char), i, near)
        by_char = np.where(long_, np.fmin(by_char, here), by_char)
        place = np.full(len(words), COMMON)
        if common[i]:
            at, to = np.array(common[i]).T
            place[at] = to
        own = np.bincount(owner * (COMMON + 1) + place[flat], minlength=len(texts) * (COMMON + 1)).reshape(-1, COMMON + 1)
        here = distance(own / np.maximum(1, sizes)[:, None], refs.shares[i])
        by_word = np.where(wordy, np.fmin(by_word, here), by_word)
        # A text of fewer words than the reference holds few of them, each too often; as long as it holds some, it is not without them.
        some = (sizes < COMMON) & (own.sum(1) - own[:, COMMON] >= FEW * (1 - refs.shares[i, COMMON]) * sizes)
        share = np.where(some, np.minimum(here / farthest[i], WORD_LIMIT), here / farthest[i])
        word_share = np.where(wordy, np.fmin(word_share, share), word_share)
    return Measured(base, by_char, [None if np.isnan(x) else refs.names[int(x)] for x in near], by_word, word_share)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) and, under the words \\n0 to \\n8 and \\nn, the summed shares of classes and the documents."""
    worker_memo("quality_rules")  # empties those of other operators
    words: dict[str | None, Counter[bytes]] = {}
    sums: dict[str | None, np.ndarray] = {}

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        for lang, c in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.float64())], ["lang", "word", "n"])
        words.clear()
        for lang, s in sums.items() if last else ():
            names = [b"\n%d" % k for k in range(CLASSES)] + [b"\nn"]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(names, pa.binary()), pa.array(s, pa.float64())], ["lang", "word", "n"])

    for batch, texts in blocks(batches):
        langs = batch.column("lang").to_pylist()
        chars = character_classes(texts)
        for text, lang, row in zip(texts, langs, chars, strict=True):
            total = row.sum()
            if lang is not None and total:
                sums.setdefault(lang, np.zeros(CLASSES + 1))
                sums[lang] += np.append(row / total, 1)
                words.setdefault(lang, Counter()).update(text.lower().encode("utf-8", "surrogatepass").split())  # marks go where words are ranked
        if sum(map(len, words.values())) > 600_000:
            yield from flush(False)
    yield from flush(True)


def references(docs: DataFrame) -> References:
    """References of the languages with LEAST_DOCS documents, from all documents (text, lang)."""
    made = docs.mapInArrow(_gather, "lang string, word binary, n double").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    made = materialize(made, "quality-words")
    is_mark = F.col("word").startswith(F.lit(b"\n"))
    sums: dict[str, dict[bytes, float]] = {}
    # A few rows for each language; the words of a language are ranked where they lie before they meet.
    enough = made.filter((F.col("word") == F.lit(b"\nn")) & (F.col("n") >= LEAST_DOCS)).select("lang")
    for r in made.filter(is_mark).join(enough, "lang").collect():
        sums.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    chars = {k: np.array([own.get(b"\n%d" % c, 0.0) for c in range(CLASSES)]) / own[b"\nn"] for k, own in sums.items()}
    mine = made.filter(~is_mark)
    lettered = mine.filter(F.decode("word", "UTF-8").rlike(r"\p{L}"))  # a mark by itself tells no language
    every = {r["lang"]: r["n"] for r in mine.groupBy("lang").agg(F.sum("n").alias("n")).join(enough, "lang").collect()}
    ranked = lettered.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= COMMON)
    words: dict[str, list[tuple[bytes, float]]] = {}
    for r in ranked.join(enough, "lang").orderBy("lang", "rank").collect():
        words.setdefault(r["lang"], []).append((bytes(r["word"]), r["n"] / every[r["lang"]]))
    return References.of(chars, words)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, near string, word_distance double, word_share double"


def _inputs(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    kind = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), kind.alias("lang"))


def _columns(texts: list[str], langs: list[str | None], refs: References) -> list[pa.Array]:
    m = measure(texts, langs, refs)
    far = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    return [*(pa.array(x, pa.int64()) for x in m.base), pa.array(m.base.failed), far(m.by_char), pa.array(m.near, pa.string()), far(m.by_word), far(m.word_share)]


def char_limits(measured: DataFrame, prefix: str = "") -> dict[str, float]:
    """For each language, the distance by characters beyond which a document near to it is far from it.

    The median and the lower quartile are exact ones of distances to four places, of all documents that pass the base
    rules; one row for each reference is collected.
    """
    near, d = F.col(f"`{prefix}near`"), F.round(F.col(f"`{prefix}char_distance`"), 4)
    found = measured.filter(~F.col(f"`{prefix}base_failed`") & near.isNotNull()).groupBy(near.alias("near")).agg(F.percentile(d, F.array(F.lit(0.25), F.lit(0.5))).alias("q"))
    return {r["near"]: r["q"][1] + SPREADS * max(LEAST_SPREAD, (r["q"][1] - r["q"][0]) / 0.6745) for r in found.collect()}


def verdict(limits: dict[str, float], prefix: str = "") -> Column:
    """Whether a measured document is kept."""
    c = lambda name: F.col(f"`{prefix}{name}`")
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[c("near")] if limits else F.lit(None).cast("double")
    far = F.coalesce(c("char_distance") > limit, F.lit(False)) | F.coalesce(c("word_share") > WORD_LIMIT, F.lit(False))
    return ~c("base_failed") & ~far


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, char_distance, word_distance.

    kept is false where the base rules fail, where the nearest language is too far by characters, or where all are by
    words. Null and empty texts have no words and fail; documents below the guards, and those of a language with fewer
    than LEAST_DOCS documents, have a null distance and are not rejected by it; rows with a null or missing language are
    judged, but make no reference; repeated rows are judged each and count each; a null id stays null; texts of any
    length are whole; other columns are ignored; no documents give no rows.
    """
    base = _inputs(docs, key, text, lang)
    sent = base.sparkSession.sparkContext.broadcast(references(base.select("text", "lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo("quality_rules")  # empties those of other operators
        for batch, texts in blocks(batches):
            made = _columns(texts, batch.column("lang").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *(x.split()[0] for x in MEASURES.split(", "))])

    measured = materialize(base.mapInArrow(run, f"doc_id long, {MEASURES}"), "quality-measured")
    return measured.select("doc_id", *COUNTS, "base_failed", verdict(char_limits(measured)).alias("kept"), "char_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that apply_rules keeps, with all their columns, whatever their names; repeated rows are judged each."""
    sent = docs.sparkSession.sparkContext.broadcast(references(_inputs(docs, "doc_id", "text", "lang").select("text", "lang")))
    known, prefix = "lang" in docs.columns, "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = [prefix + x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memo("quality_rules")  # empties those of other operators
        for batch, texts in blocks(batches):
            langs = batch.column("lang").cast(pa.string()).to_pylist() if known else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(texts, langs, sent.value)], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for name, kind in (x.split() for x in MEASURES.split(", ")):
        schema = schema.add(prefix + name, kind)
    measured = materialize(docs.mapInArrow(run, schema), "quality-measured")
    return measured.filter(verdict(char_limits(measured, prefix), prefix)).select(*(F.col(f"`{c}`") for c in docs.columns))
