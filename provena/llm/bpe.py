"""BPE encoding through a minimal acyclic transducer, with exact merges for unseen words, and decoding.

The frequent words of the corpus are encoded once and compiled into a minimal deterministic acyclic automaton whose
transitions carry numbers: along a word's path they add up to the word's rank among the sorted words, which finds
its ids. Equal right languages share their states, so suffixes are stored once. The automaton is one block of flat
arrays that each worker maps from an unlinked file; lookups go through it for all new words of a block at once.
Words outside it are merged exactly, lowest rank first and leftmost among equals.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import materialize, worker_memo

LEXICON_WORDS = 65_536  # most words of the automaton
LEXICON_BYTES = 32  # longest word of the automaton
MEMO = 300_000  # texts between white space that a worker remembers
SLICE = 1_000_000  # code points of a text handled at once
BLOCK = 2_000_000  # code points of a block of texts

NONE = 1 << 60  # stands for a pair that is never merged

SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
_SPACE = "\t-\r \x85\xa0"


def _ranges(kind: str) -> str:
    """A character class body with the code points below U+0250 of one major category."""
    found = [chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind]
    return "".join(map(re.escape, found))


_L, _N = _ranges("L"), _ranges("N")
#: Below U+0250 (but for the letters named here) Python and the library agree on case, classes and composition.
EXOTIC = re.compile("[^\x00-\x1b\x20-ɏ]|[İȺȾ]")
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")


@cache
def byte_letters() -> list[str]:
    """The usual printable letter for each byte: itself where printable, else the next free one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with word-end marks, from its JSON file's content."""

    def __init__(self, content: bytes):
        model = (doc := json.loads(content))["model"]
        self.content, end = content, model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.tokens = [b""] * (max([*ids.values(), *(t["id"] for t in doc["added_tokens"])]) + 1)
        for t, i in [*ids.items(), *((t["content"], t["id"]) for t in doc["added_tokens"])]:
            self.tokens[i] = t.encode()
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        letters = byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + end] for c in letters]
        self.from_letter = {c: b for b, c in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {ids[a] << 20 | ids[b]: rank << 20 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        known = np.array(sorted(self.merges.items()), np.int64).reshape(-1, 2)
        self.pairs, self.values = known[:, 0].copy(), np.append(known[:, 1], NONE)
        self.first_symbols, self.last_symbols = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        #: Values of all pairs of a byte and the next one, which the word may end with.
        self.of_bytes = np.stack([self._values(np.repeat(self.first_symbols, 256), np.tile(x, 256)) for x in (self.first_symbols, self.last_symbols)]).ravel()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(symbols) > 256:
            return self._merge_long(symbols)
        get, none = self.merges.get, NONE
        found = [get(a << 20 | b, none) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while found and (least := min(found)) != none:
            at = found.index(least)
            symbols[at : at + 2] = [new := least & 0xFFFFF]
            del found[at]
            if at:
                found[at - 1] = get(symbols[at - 1] << 20 | new, none)
            if at < len(found):
                found[at] = get(new << 20 | symbols[at + 1], none)
        return symbols

    def _merge_long(self, s: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        get, n = self.merges.get, len(s)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(v >> 20, i, s[i], s[i + 1], v & 0xFFFFF) for i in range(n - 1) if (v := get(s[i] << 20 | s[i + 1])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or s[i] != a or s[j] != b:
                continue
            s[i], gone[j], after[i] = new, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (v := get(s[left] << 20 | s[right])) is not None:
                    heapq.heappush(heap, (v >> 20, left, s[left], s[right], v & 0xFFFFF))
        return [x for x, dead in zip(s, gone, strict=True) if not dead]


    def _values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.values[at], NONE) if len(self.pairs) else np.full(len(key), NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words at once, as bytes: every round makes each word's next merge."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) <= 256:
                short.append(i)
            else:
                out[i] = np.array(self.merge(w), np.uint32).tobytes()
        if not short:
            return out
        size = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        flat = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        ends = np.cumsum(size) - 1
        symbol = self.first_symbols[flat]
        symbol[ends] = self.last_symbols[flat[ends]]
        two = (flat[:-1].astype(np.int64) << 8) | flat[1:]
        two[ends[size > 1] - 1] += 1 << 16
        value = np.append(self.of_bytes[two], NONE)
        value[ends] = NONE
        which, owner = np.array(short), np.repeat(np.arange(len(short)), size)  # words still open; the word of each symbol
        while len(which):
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(value, starts)
            done = least == NONE
            if done.any():
                gone = done[owner]
                ids, at = symbol[gone].astype(np.uint32).tobytes(), 0
                for i, n in zip(which[done].tolist(), (size[done] * 4).tolist(), strict=True):
                    out[i] = ids[at : at + n]
                    at += n
                which, size, least = which[~done], size[~done], least[~done]
                symbol, value = symbol[~gone], value[~gone]
                owner = np.repeat(np.arange(len(which)), size)
                if not len(which):
                    break
            hit = np.flatnonzero(value == least[owner])
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]  # the leftmost of each word
            symbol[hit] = least & 0xFFFFF
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, value, owner, size = symbol[stay], value[stay], owner[stay], size - 1
            hit -= np.arange(len(hit))
            value[hit] = NONE
            after = hit[(hit + 1 < len(owner)) & (owner[np.minimum(hit + 1, len(owner) - 1)] == owner[hit])]
            before = hit[(hit > 0) & (owner[hit - 1] == owner[hit])] - 1
            for at in (after, before):
                value[at] = self._values(symbol[at], symbol[at + 1])
        return out


class Lexicon:
    """The automaton: transitions sorted by (state, byte), each with target and number, and the words' ids."""

    def __init__(self, block: bytes | memoryview):
        head = np.frombuffer(block, np.int64, 5)
        n_trans, n_states, n_words, n_ids, self.root = map(int, head)
        at = 40

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, kind, n, at)
            at += out.nbytes + (-out.nbytes) % 8
            return out

        self.keys, self.target, self.number = take(np.int64, n_trans), take(np.int32, n_trans), take(np.int32, n_trans)
        self.final, self.starts, self.ids = take(np.uint8, n_states), take(np.int32, n_words + 1), take(np.uint32, n_ids)

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        """Minimal automaton of the words by adding them in order and freezing finished suffixes."""
        ordered = sorted(w for w in words if 0 < len(w) <= LEXICON_BYTES)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # frozen: (final, ((byte, target), ...))

        def freeze(final: bool, edges: list) -> int:
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # open states along the last word; an edge's target is set when frozen
        last = b""
        for word in [*ordered, None]:
            same = 0
            if word is not None:
                while same < min(len(last), len(word)) and last[same] == word[same]:
                    same += 1
            for depth in range(len(last), same, -1):
                final, edges = path.pop()
                path[-1][1].append((last[depth - 1], freeze(final, edges)))
            if word is not None:
                path += [[False, []] for _ in word[same:]]
                path[-1][0], last = True, word
        root = freeze(*path[0])
        below = []  # words reachable from each state; targets are frozen before their sources
        for final, edges in states:
            below.append(int(final) + sum(below[t] for _, t in edges))
        keys, target, number = [], [], []
        for i, (final, edges) in enumerate(states):
            passed = int(final)
            for byte, t in edges:
                keys.append(i << 8 | byte)
                target.append(t)
                number.append(passed)
                passed += below[t]
        ids = [words[w] for w in ordered]
        parts = [
            np.array([len(keys), len(states), len(ordered), sum(map(len, ids)), root], np.int64),
            np.array(keys, np.int64), np.array(target, np.int32), np.array(number, np.int32), np.array([f for f, _ in states], np.uint8),
            np.cumsum([0, *map(len, ids)]).astype(np.int32), np.array([x for w in ids for x in w], np.uint32),
        ]
        return b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @staticmethod
    def mapped(block: bytes) -> Lexicon:
        """Map the block from a file that no longer has a name."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return Lexicon(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word as bytes, or None where the automaton lacks it; all words advance together."""
        out: list[bytes | None] = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES))
        if not len(live) or not len(self.keys):
            return out
        flat = np.frombuffer(b"".join([words[i] for i in live]), np.uint8)
        size = size[live]
        first = np.cumsum(size) - size
        state, rank, step = np.full(len(live), self.root), np.zeros(len(live), np.int64), 0
        while len(live):
            done = size == step
            if done.any():
                hit = done & (self.final[state] > 0)
                for i, r in zip(live[hit], rank[hit], strict=True):
                    out[i] = self.ids[self.starts[r] : self.starts[r + 1]].tobytes()
                live, size, first, state, rank = (x[~done] for x in (live, size, first, state, rank))
            key = state << 8 | flat[first + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, size, first, at, rank = live[ok], size[ok], first[ok], at[ok], rank[ok]
            state, rank, step = self.target[at].astype(np.int64), rank + self.number[at], step + 1
        return out


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, content: bytes, lexicon: bytes | None = None):
        self.vocab = Vocabulary(content)
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else None
        self.owner = "bpe " + hashlib.sha256(content).hexdigest()  # the ids of a word do not depend on the lexicon
        self.memo: dict[str, bytes] = worker_memo(self.owner)

    @property
    def library(self):
        from tokenizers import Tokenizer

        if not hasattr(self, "_library"):
            self._library = Tokenizer.from_str(self.vocab.content.decode())
        return self._library

    def chunks(self, text: str) -> list[str]:
        """Keys whose ids, in order, are the text's: lower-case runs between white space; a leading newline
        marks a special token and a leading tab a word that the library's normaliser and splitter have made."""
        if "<|" in text and len(parts := SPECIAL.split(text)) > 1:
            return [k for i, p in enumerate(parts) for k in (["\n" + p] if i % 2 else self.chunks(p))]
        if (text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")) or not EXOTIC.search(text):
            return text.lower().split()
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return ["\t" + w for w, _ in words]

    def words(self, key: str) -> list[bytes]:
        if key[0] == "\t":
            return [bytes(self.vocab.from_letter[c] for c in key[1:])]
        if key.isalpha():
            return [key.encode()]
        if key[:-1].isalpha():
            return [key[:-1].encode(), key[-1].encode()]
        return [w.encode("utf-8", "surrogatepass") for w in WORD.findall(key)]

    def learn(self, keys: set[str]) -> None:
        """Put the ids of new keys into the memo."""
        if len(self.memo) + len(keys) > MEMO:
            self.memo.clear()
        memo, merge, mixed = self.memo, [], {}
        for k in keys:
            if k in memo:
                continue
            if k[0] == "\n":
                memo[k] = np.array([self.vocab.special[k[1:]]], np.uint32).tobytes()
            elif k[0] != "\t" and k.isalpha():
                merge.append(k)
            else:
                mixed[k] = self.words(k)
        memo.update(zip(merge, self._ids_of([k.encode() for k in merge]), strict=True))
        # The words within other keys are often keys themselves.
        parts: dict[bytes, bytes | None] = dict.fromkeys(w for ws in mixed.values() for w in ws)
        for w in parts:
            parts[w] = memo.get(w.decode("utf-8", "replace")) if w[0] > 0x20 else None
        new = [w for w, ids in parts.items() if ids is None]
        parts.update(zip(new, self._ids_of(new), strict=True))
        for k, ws in mixed.items():
            memo[k] = parts[ws[0]] if len(ws) == 1 else b"".join([parts[w] for w in ws])

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: those of the lexicon, and the others merged."""
        out: list[bytes | None] = self.lexicon.lookup(words) if self.lexicon else [None] * len(words)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i in range(0, len(rest), 10_000):
            some = rest[i : i + 10_000]
            for j, ids in zip(some, self.vocab.merge_many([words[j] for j in some]), strict=True):
                out[j] = ids
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one text; long texts go slice by slice, cut at spaces, which no word crosses."""
        at, out = 0, []
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE else text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            keys = self.chunks(text[at:end])
            try:
                out += [self.memo[k] for k in keys]
            except KeyError:
                self.learn(set(keys))
                out += [self.memo[k] for k in keys]
            at = end
        return b"".join(out)

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the new words of the whole block are looked up together."""
        split = [self.chunks(t) if len(t) <= SLICE else [] for t in texts]
        keys = list(chain.from_iterable(split))
        found = list(map(self.memo.get, keys))
        if new := [i for i, ids in enumerate(found) if ids is None]:
            fresh = {keys[i] for i in new}
            if len(self.memo) + len(fresh) > MEMO:  # what this block has met again stays
                met = {k: ids for k, ids in zip(keys, found, strict=True) if ids is not None}
                self.memo.clear()
                self.memo.update(met)
            self.learn(fresh)
            for i in new:
                found[i] = self.memo[keys[i]]
        out, at = [], 0
        for text, own in zip(texts, split, strict=True):
            out.append(self.encode(text) if len(text) > SLICE else b"".join(found[at : at + len(own)]))
            at += len(own)
        return out

    def decode(self, ids: bytes) -> bytes:
        """Tokens joined by spaces, as this vocabulary, which names no decoder, decodes."""
        tokens = self.vocab.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, np.uint32).tolist()])


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(content: bytes, lexicon: bytes | None = None) -> Encoder:
    """This worker's encoder for a vocabulary and a lexicon; kept from task to task, the last two of them."""
    key = hashlib.sha256(content + (lexicon or b"")).digest()
    if key not in _ENCODERS:
        while len(_ENCODERS) > 1:
            _ENCODERS.pop(next(iter(_ENCODERS)))
        _ENCODERS[key] = Encoder(content, lexicon)
    worker_memo(_ENCODERS[key].owner)
    return _ENCODERS[key]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with texts of about that many bytes."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= most or i + 1 == len(lengths):
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches of about BLOCK bytes, with their texts; null texts are empty."""
    for batch in parts(batches, text):
        yield batch, [t or "" for t in batch.column(text).to_pylist()]


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _count_words(content: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maker = encoder(content)
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        words: Counter[bytes] = Counter()
        for key, n in counts.items():
            for w in maker.words(key) if key[0] != "\n" else ():
                if len(w) <= LEXICON_BYTES:
                    words[w] += n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    for _, texts in blocks(batches):
        for t in texts:
            counts.update(maker.chunks(t))
        if len(counts) > 250_000:
            yield flush()
    yield flush()


def frequent_words(docs: DataFrame, content: bytes, text: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The words of all texts whose counts are highest, `most` at the utmost; equal counts stay or go together."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(lambda it: _count_words(content, it), "word binary, n long")
    counted = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "bpe-words")
    grade = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 16 + 864)).cast("int")
    grades = counted.groupBy(grade.alias("grade")).count().collect()  # under two thousand grades
    left, least = most, None
    for r in sorted(grades, key=lambda r: -r["grade"]):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["grade"]
    if least is None:
        return []
    return [bytes(r["word"]) for r in counted.filter(grade >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, text: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """Compile the corpus's frequent words, a bounded number, into an automaton block."""
    vocab = Vocabulary(content := vocabulary_bytes(vocabulary))
    return Lexicon.compile({w: vocab.merge(w) for w in frequent_words(docs, content, text, most)})


def encode(docs: DataFrame, vocabulary: str, lexicon: bytes | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian unsigned 32-bit), decoded (their text).

    Null and empty texts have no ids; repeated rows are encoded each; a null id stays null; other columns are ignored.
    Texts of any length are encoded whole; no documents give no rows. The vocabulary
    and the lexicon go to the workers by broadcast: both are of fixed size. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary_bytes(vocabulary), lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*sent.value)
        for batch, texts in blocks(batches):
            ids = own.encode_block(texts)
            decoded = pa.array([own.decode(x) for x in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The input's rows with a column `decoded`; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value)
        for batch in batches:
            found = [None if x is None else own.decode(x).decode() for x in batch.column(ids).to_pylist()]
            yield batch.append_column("decoded", pa.array(found, pa.string()))

    return rows.drop("decoded").mapInArrow(run, rows.drop("decoded").schema.add("decoded", "string"))
