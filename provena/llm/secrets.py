"""Secret scanning: fixed patterns, then the compression novelty of strings in sensitive contexts.

A candidate is a run of at least twelve secret-like characters that follows a name with a sensitive word in it, of any length, and an
assignment, an opening bracket, ` is ` or a blank within one line, or the lines of a private key's block of at least 32 characters. Its novelty is its marginal cost: bytes of the surrounding text with the candidate in its
place, less bytes without it, both compressed by zstandard primed with a dictionary of identifiers: a fixed list of
those around secrets, and the names that most documents of the corpus use, candidates' values left out. What the
dictionary and the surroundings explain costs little; a random string costs nearly its entropy. Candidates that stay
incompressible are reported.

Zstandard stores the letters of a short text as they are, so that a new word costs as much as a random key. A candidate
without both a digit and a letter must therefore be costly by pairs of characters too, as learnt from the dictionary and
from its own document, itself taken out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import blocks
from provena.llm.common import materialize, worker_memo

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: A name before an assignment or an opening bracket, and the first characters of a value; names have any length.
NAMED = re.compile(
    r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=(["']?[\x20\t]*(?:=>|[:=(]|\x20is\x20|\x20)[\x20\t]*["']?)[A-Za-z0-9+/_.=~!@\#$%^&*-]{12})""",
    re.ASCII,
)
VALUE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]+", re.ASCII)
#: Words that make a name sensitive, beyond those of the assign pattern.
SENSITIVE = re.compile(
    r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|credential|auth|bearer|signature|session[_-]?id|cookie",
    re.IGNORECASE | re.ASCII,
)

#: What these two patterns look for, each way of writing it; one of them stands in every lower-cased text in which they find something.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE_WORDS = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "credential", "auth", "bearer", "signature", "cookie",
    *(f"{a}{by}{b}" for a, b in (("api", "key"), ("access", "key"), ("private", "key"), ("client", "key"), ("session", "id")) for by in ("", "_", "-")),
)

#: Identifiers that code around secrets is made of; they prime the dictionary.
IDENTIFIERS = """
import from return def class self const let var function public private static final void string int bool null none true
false config settings environment os.environ getenv process.env headers Authorization Bearer Basic username password
passwd secret token api_key apikey access_key secret_key private_key client_id client_secret credentials session_id
cookie signature refresh_token access_token id_token endpoint https http localhost database host port user connection
example changeme placeholder undefined required optional default value key name type data json yaml response request
aws_access_key_id aws_secret_access_key github gitlab slack stripe azure google service_account BEGIN END PRIVATE KEY
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000 xxxxxxxx ********
"""

#: The lines of a private key, which may be written with escaped line ends.
KEY_BLOCK = re.compile(r"PRIVATE\x20KEY-----((?:\\n|[A-Za-z0-9+/=\s])+)", re.ASCII)

CONTEXT = 256  # code points of surrounding text on either side
LEAST_BITS = 4.0  # marginal bits per byte from which a candidate counts as incompressible
PAIR_BITS = 5.2  # bits per character by pairs, for candidates without both a digit and a letter
#: Common words of several languages, which teach pairs of letters where a document is short.
WORDS = """
the and that have with this from they will would there their what about which when make like time just know take people
into year your good some could them other than then look only come over think also back after work first well even want
because these give most ordinary looking words here standard information management application service between
under each before through during without another however something national general important following system
que los las una por con para como pero sus este entre cuando todo esta ser son dos tambien fue habia desde nos durante
les des est dans qui une pour pas sur plus avec sont mais comme tout nous vous leur cette entre aussi bien sans deux
der die und den von das mit sich des auf ist nicht ein eine als auch nach wie aus bei einer werden oder haben sind noch
"""


#: Names that documents use; letters alone, so that no key is among them.
NAME = re.compile(r"[^\W\d]{4,24}")
CAPITALISED = re.compile(r"(?:[A-Z]?[a-z]{2,})+", re.ASCII)  # words run together, each perhaps with a capital
DICTIONARY_BYTES = 32_768  # of the corpus's names in the dictionary, the commonest
LEAST_USERS = 3  # documents that use such a name


def _pairs(text: str) -> tuple[Counter[tuple[str, str]], Counter[str]]:
    return Counter(zip(text, text[1:], strict=False)), Counter(text)


class Novelty:
    """Marginal costs of strings, given the names of a corpus."""

    def __init__(self, names: tuple[str, ...] = ()):
        known = " ".join((IDENTIFIERS + WORDS).split())
        # What stands last in a dictionary is cheapest to point to.
        primed = zstandard.ZstdCompressionDict((" ".join(reversed(names)) + " " + " ".join(IDENTIFIERS.split())).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=19)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, level=19, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.usual = _pairs(known + " " + " ".join(names))
        self.n_usual = self.usual[1].total()

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def marginal_bits(self, before: str, value: str, after: str) -> float:
        """Bits per byte that the value adds to its compressed surroundings."""
        return 8 * (self.size(before + value + after) - self.size(before + after)) / max(1, len(value.encode("utf-8", "surrogatepass")))

    def pair_bits(self, value: str, text: str, own: tuple[Counter[tuple[str, str]], Counter[str]]) -> float:
        """Bits per character of the value after the character before, by usual names and its text, whose pairs are own, without it."""
        times, mine, usual = text.count(value), _pairs(value), self.usual
        shown = value.lower() if value.isupper() or CAPITALISED.fullmatch(value) else value
        pair = lambda a, b: usual[0][a, b] + max(0, own[0][a, b] - times * mine[0][a, b])
        single = lambda a: usual[1][a] + max(0, own[1][a] - times * mine[1][a])
        n = self.n_usual + max(0, len(text) - times * len(value))
        bits = [math.log2((single(a) + 4) / (pair(a, b) + 4 * (single(b) + 0.5) / (n + 64))) for a, b in zip(" " + shown, shown, strict=False)]
        return sum(bits) / max(1, len(bits))


@cache
def novelty(names: tuple[str, ...] = ()) -> Novelty:
    return Novelty(names)


def holds(text: str, words: tuple[str, ...]) -> bool:
    """Whether one of the words stands in the text, in either case: many times as fast as a pattern of them."""
    low = text.lower()
    return any(w in low for w in words)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed kinds, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if holds(text, ASSIGN_WORDS) else []
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in sensitive contexts, in order, none within another."""
    found: list[tuple[int, int]] = []
    end = 0
    for m in NAMED.finditer(text) if holds(text, SENSITIVE_WORDS) else ():
        if m.start() >= end and SENSITIVE.search(m[1]):
            end = VALUE.match(text, m.end(2)).end()
            found.append((m.end(2), end))
    if "PRIVATE KEY-----" in text:
        blocks_ = [(m.start(1), m.start(1) + len(m[1].rstrip())) for m in KEY_BLOCK.finditer(text)]
        blocks_ = [(a, b) for a, b in blocks_ if b - a >= 32]
        found = sorted([*blocks_, *((a, b) for a, b in found if not any(x <= b and a <= y for x, y in blocks_))])
    return found


def novel_spans(text: str, known: list[tuple[int, int, int]], own_names: Novelty | None = None, least_bits: float = LEAST_BITS) -> list[tuple[int, int, int]]:
    """Spans of incompressible values in sensitive contexts that no known span covers."""
    judge, found, own = own_names or novelty(), [], None
    for a, b in candidates(text):
        value = text[a:b]
        if any(s <= a and b <= e for s, _, e in known):
            continue
        if judge.marginal_bits(text[max(0, a - CONTEXT) : a], value, text[b : b + CONTEXT]) < least_bits:
            continue
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if not mixed:
            own = own or _pairs(text)
        if mixed or judge.pair_bits(value, text, own) >= PAIR_BITS:
            found.append((a, 3, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def all_spans(text: str, own_names: Novelty | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, own_names))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names and how many of the documents use them; values of candidates and of the fixed kinds are cut out first."""
    worker_memo("secrets")  # empties those of other operators
    users: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in users], pa.binary()), pa.array(list(users.values()), pa.int64())], ["name", "n"])
        users.clear()
        return out

    for _, texts in blocks(batches):
        for text in texts:
            spans = sorted([(a, b) for a, _, b in base_spans(text)] + candidates(text))
            if spans:
                pieces, end = [], 0
                for a, b in spans:
                    pieces.append(text[end : max(a, end)])
                    end = max(end, b)
                text = " ".join([*pieces, text[end:]])
            users.update(set(NAME.findall(text)))
        if len(users) > 150_000:
            yield flush()
    yield flush()


def usual_names(docs: DataFrame, text: str = "text", most_bytes: int = DICTIONARY_BYTES) -> tuple[str, ...]:
    """The names that most documents use, counted over all of them, the commonest first, as many as most_bytes hold."""
    made = docs.select(F.col(text).alias("text")).mapInArrow(_names, "name binary, n long")
    counted = materialize(made.groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_USERS), "secret-names")
    out, size = [], 0
    for r in counted.orderBy(F.desc("n"), "name").limit(most_bytes // 5).collect():  # a name takes five bytes or more
        name = bytes(r["name"]).decode("utf-8", "surrogatepass")
        size += len(r["name"]) + 1
        if size > most_bytes:
            break
        out.append(name)
    return tuple(out)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(names: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memo("secrets")  # empties those of other operators
    judge = novelty(names)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, every = all_spans(text or "", judge)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names_ = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names_)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. names prime the dictionary, by
    default those of the documents themselves, from a pass over all of them. Null and empty texts have no spans; a null
    id stays null; repeated rows are scanned each; texts and values of any length are whole; other columns are ignored;
    no documents give no rows.
    """
    names = usual_names(docs, text) if names is None else names
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _scan(names, it), SCHEMA)


def _redact(names: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memo("secrets")  # empties those of other operators
    judge = novelty(names)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text in batch.column(at).to_pylist():
            spans = all_spans(text, judge)[1] if text else []
            if spans:
                pieces, end = [], 0
                for a, k, b in spans:
                    if b > end:
                        pieces += [text[end : max(a, end)], f"[{KINDS[k]} removed]" if a >= end else ""]
                        end = b
                text = "".join(pieces) + text[end:]
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def redact_secrets(docs: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The same rows and columns with every span of `text` replaced by a mark naming its kind; null stays null.

    names as in scan_secrets. Other columns, whatever their names, stay; repeated rows stay each; no rows give none.
    """
    names = usual_names(docs) if names is None else names
    return docs.mapInArrow(lambda it: _redact(names, it), docs.schema)


def without_secrets(docs: DataFrame) -> DataFrame:
    """redact_secrets, with n_chars, where there is such a column, brought up to date."""
    clean = redact_secrets(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(clean.schema["n_chars"].dataType), F.col("n_chars")))
    return clean
