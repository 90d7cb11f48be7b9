"""Near-duplicate classes by DartMinHash over weighted word shingles.

A document is a weighted set: its runs of five words, each weighing as often as it occurs. Every copy of a shingle is
a region of unit weight in which darts lie at fixed, hashed places: a Poisson number of darts for each stretch of
the rank axis, each with a coordinate and a rank. Of all darts in a document's regions, the earliest of each
coordinate forms its signature, so two documents agree in a coordinate with probability equal to their weighted
Jaccard similarity. Only ranks up to a bound set by the document's weight are thrown, more where a coordinate stays
empty; stretches double in length, so that documents of different weight throw the same darts.

Bands of the signature are joined. Texts with the same words are one class from the start. In each band's bucket
every text is compared by its regions with the two hubs of the bucket. Where a bucket still holds several components,
the members outside its largest one are compared with each other and with those of the largest one, in blocks of bounded
size; members of the largest one need no comparison among themselves, so a bucket of one component and an outsider costs
what its members are. Connected components of the links are the classes. Regions are 32-bit hashes: a similarity is
exact but for their collisions, of which a pair of texts of a thousand words each has one in some two thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import blocks
from provena.llm.common import materialize, worker_memo
from provena.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K  # thrown on average before coordinates are looked at
FIRST = 6  # the first stretch is [0, 2**-FIRST), the n-th one ends at 2**(n - FIRST)
SIDE = 512  # texts on each side of a block of comparisons
GROUP_BYTES = 16_000_000  # of regions in a group of blocks, about
COLUMNS = 8192  # regions multiplied at once

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_S = [np.uint64(x) for x in (30, 27, 31, 32, 11)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche hash of 64-bit integers."""
    x = (x ^ x >> _S[0]) * _C[1]
    x = (x ^ x >> _S[1]) * _C[2]
    return x ^ x >> _S[2]


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, up to where they reach one."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 16))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(logs))


_STRETCHES = [(0.0, 2.0**-FIRST)] + [(2.0 ** (j - 1 - FIRST), 2.0 ** (j - 1 - FIRST)) for j in range(1, 24)]  # (from, length)
_COUNTS = [_poisson(length) for _, length in _STRETCHES[:18]]


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Shingler:
    """Sets of unit regions: 32-bit hashes of (shingle, number of its copy), sorted."""

    def regions(self, ws: list[bytes]) -> np.ndarray:
        if not ws:
            return np.zeros(0, np.uint32)
        memo: dict[bytes, int] = worker_memo("dartminhash")
        try:
            ids = np.fromiter([memo[w] for w in ws], np.uint64, len(ws))
        except KeyError:
            if len(memo) > 200_000:
                memo.clear()
            for w in ws:
                if w not in memo:
                    memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            ids = np.fromiter([memo[w] for w in ws], np.uint64, len(ws))
        n = max(1, len(ids) - SHINGLE + 1)
        h = np.full(n, min(len(ids), SHINGLE), np.uint64)
        for k in range(min(SHINGLE, len(ids))):
            h = _mix(h * _C[0] + ids[k : k + n])
        h.sort()
        first = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.arange(n)
        copy = at - np.maximum.accumulate(np.where(first, at, 0))
        return np.unique((_mix(h + copy.astype(np.uint64) * _C[3]) >> _S[3]).astype(np.uint32))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Earliest dart of each coordinate for each set of regions, shape (sets, K); sets may not be empty."""
    out = np.zeros((len(sets), K), np.uint64)
    todo = np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    most = np.maximum(0, np.ceil(np.log2(DARTS / np.maximum(size, 1))).astype(int) + FIRST)
    while len(todo):
        regions = np.concatenate([sets[i] for i in todo]).astype(np.uint64)
        owner = np.repeat(np.arange(len(todo)), size[todo])
        last = most[todo][owner]
        found = []
        for j in range(int(most[todo].max()) + 1):
            live = np.flatnonzero(last >= j) if j else slice(None)
            seed = _mix(regions[live] * _C[0] + np.uint64((j * int(_C[3]) + 1) % 2**64))
            start, length = _STRETCHES[j]
            count = np.searchsorted(_COUNTS[j], (seed >> _S[4]).astype(np.float64) * 2.0**-53) if j < len(_COUNTS) else np.full(len(seed), int(length))
            hit = np.flatnonzero(count)
            n = count[hit]
            number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            dart = _mix(np.repeat(seed[hit], n) + (number.astype(np.uint64) + np.uint64(1)) * _C[0])
            place = _mix(dart + _C[3])
            rank = start + length * ((place >> _S[4]).astype(np.float64) * 2.0**-53)
            coordinate = (dart >> _S[3]).astype(np.int64) * K >> 32
            found.append((np.repeat(owner[live][hit], n) * K + coordinate, rank, dart))
        cell, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        got = np.zeros(len(todo) * K, np.uint64)
        full = np.zeros(len(todo) * K, bool)
        got[cell[first]], full[cell[first]] = dart[first], True
        done = full.reshape(-1, K).all(1)
        out[todo[done]] = got.reshape(-1, K)[done]
        todo = todo[~done]
        most[todo] += 1  # a coordinate stayed empty: throw farther
    return out


def signatures_in_parts(sets: list[np.ndarray], most: int = 200_000) -> np.ndarray:
    """The same for any number of sets, about `most` regions at a time."""
    parts, held, n = [np.zeros((0, K), np.uint64)], [], 0
    for s in sets:
        held.append(s)
        n += len(s)
        if n >= most:
            parts.append(signatures(held))
            held, n = [], 0
    if held:
        parts.append(signatures(held))
    return np.concatenate(parts)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, shape (sets, BANDS)."""
    part = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        h = _mix(h * _C[0] + part[:, :, r])
    return h.view(np.int64)


_SHINGLER = Shingler()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        split = [words(t) for t in texts]
        digests = [hashlib.blake2b(b" ".join(ws), digest_size=16).digest() for ws in split]
        sets = [_SHINGLER.regions(ws) for ws in split]
        keys: list[list[int] | None] = [None] * len(sets)
        some = [i for i, s in enumerate(sets) if len(s)]
        for i, row in zip(some, bands(signatures_in_parts([sets[i] for i in some])).tolist(), strict=True):
            keys[i] = row
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "bands"]
        )


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        made = [_SHINGLER.regions(words(t)).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["id", "regions"])


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two region sets; 0 where both are empty."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def _verify(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), strict=True)
        keep = pa.array([similarity(a, b) >= least for a, b in pairs], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _verified(pairs: DataFrame, regions: DataFrame, least: float, label: str) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the least, stored."""
    one = pairs.join(regions.select(F.col("id").alias("a"), F.col("regions").alias("ra")), "a")
    two = one.join(regions.select(F.col("id").alias("b"), F.col("regions").alias("rb")), "b")
    return materialize(two.select("a", "b", "ra", "rb").mapInArrow(lambda it: _verify(least, it), "a long, b long").distinct(), label)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of dense slices of the membership matrix."""
    size = np.array([len(x) for x in sets])
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # a region of one text is in no intersection
    place = np.full(len(value), -1)
    place[shared] = np.arange(len(shared))
    column, row = place[at], np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, len(shared), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, len(shared) - start)), np.float32)
        x[row[lo:hi], column[lo:hi] - start] = 1
        out += x @ x.T
    return out


def _linked(ids: np.ndarray, comps: np.ndarray, across: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join the components of these texts, no more than it takes, among the pairs that are across."""
    common, size = _common(sets), np.array([len(x) for x in sets], np.float32)
    alike = common >= least * (size[:, None] + size[None, :] - common) - 1e-3
    near = np.argwhere(np.triu(alike & across & (comps[:, None] != comps[None, :]), 1))
    above = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c

    out = []
    for i, j in near.tolist():
        x, y = root(int(comps[i])), root(int(comps[j]))
        if x != y and similarity(sets[i].tobytes(), sets[j].tobytes()) >= least:
            above[max(x, y)] = min(x, y)
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _compare(least: float, table: pa.Table) -> pa.Table:
    """Links between texts of different components, for each bucket of a group of blocks."""
    table = table.sort_by([("bucket", "ascending"), ("id", "ascending")])
    bucket, ids, comps, mine = (table.column(c).to_numpy() for c in ("bucket", "id", "comp", "mine"))
    one_side = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    regions = table.column("regions").to_pylist()
    links = []
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo > 1:
            side = mine[lo:hi]
            across = np.ones((hi - lo, hi - lo), bool) if one_side else side[:, None] != side[None, :]
            links += _linked(ids[lo:hi], comps[lo:hi], across, [np.frombuffer(x, np.uint32) for x in regions[lo:hi]], least)
    a, b = zip(*links, strict=True) if links else ([], [])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, the smallest doc_id that its links lead to.

    Links join texts of equal words, ASCII and other letters lower-cased, and texts whose weighted Jaccard similarity
    over five-word shingles is 0.8 or more. A text of fewer words is one shingle; null and empty texts have no
    links. Rows that share an id share a class; a null id has a null class. Other columns are ignored. Texts of any
    length are signed whole; no documents give no rows.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(base.mapInArrow(_sign, "doc_id long, digest binary, bands array<long>"), "dart-signed")
    linked = signed.filter("doc_id is not null and bands is not null")
    texts = materialize(linked.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "dart-texts")
    placed = texts.select("id", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("id"), "id")
    hubs = placed.groupBy("bucket").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n")).filter("n > 1")
    hubs = materialize(hubs.select("bucket", "n", F.array_distinct(F.array("lo.id", "hi.id")).alias("hubs")), "dart-hubs")
    members = materialize(placed.join(hubs, "bucket"), "dart-members")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = members.select("id", F.explode("hubs").alias("hub")).filter("id <> hub").select(*pair("id", "hub")).distinct()
    pairs = materialize(pairs, "dart-pairs")
    needed = materialize(members.select("id").distinct(), "dart-needed")
    regions = base.join(needed, base["doc_id"] == needed["id"], "left_semi").mapInArrow(_regions, "id long, regions binary")
    regions = materialize(regions, "dart-regions")
    links = _verified(pairs, regions, least, "dart-links")
    roots = materialize(connected_components(links, "a", "b", "dart-components"), "dart-roots")
    more = _rest(members, roots, regions, least)
    if more is not None:
        links = links.unionByName(more)
        roots = materialize(connected_components(links, "a", "b", "dart-components"), "dart-roots")
    classes = texts.select("digest", "id").join(roots, texts["id"] == roots["node"], "left")
    classes = materialize(classes.select("digest", F.coalesce("root", "id").alias("class_id")), "dart-classes")
    out = signed.select("doc_id", "digest", F.col("bands").isNotNull().alias("has")).join(classes, "digest", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.when(F.col("has"), F.col("class_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", mine.alias("class_id"))


def _rest(members: DataFrame, roots: DataFrame, regions: DataFrame, least: float) -> DataFrame | None:
    """Links that the hubs have not shown: between texts of a bucket of three or more that are not yet of one component.

    In every bucket the members outside its largest component are dealt to sides 0, 1, ..., those of the largest one to
    sides -1, -2, ...; a block is a pair of sides of which the first is outside.
    """
    large = materialize(members.filter("n > 2").select("bucket", "id"), "dart-large")
    placed = large.join(roots, large["id"] == roots["node"], "left").select("bucket", "id", F.coalesce("root", "id").alias("comp"))
    placed = materialize(placed, "dart-placed")
    per = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    mixed = per.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("main")).filter("comps > 1")
    mixed = materialize(mixed.select("bucket", (F.col("n") - F.col("main.k")).alias("n_out"), F.col("main.k").alias("n_main"), F.col("main.comp").alias("main")), "dart-mixed")
    if mixed.isEmpty():
        return None
    open_ = materialize(placed.join(mixed, "bucket"), "dart-open")
    sides = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    out, spread = F.col("comp") != F.col("main"), F.xxhash64("id", "bucket")
    side = F.when(out, F.pmod(spread, sides("n_out"))).otherwise(-1 - F.pmod(spread, sides("n_main"))).cast("int")
    others = F.when(out, F.sequence(-sides("n_main"), sides("n_out") - 1)).otherwise(F.sequence(F.lit(0), sides("n_out") - 1))
    dealt = open_.withColumn("mine", side).withColumn("others", others)
    n_bytes = dealt.join(regions.select("id", F.octet_length("regions").alias("k")), "id").agg(F.sum(F.col("k") * F.size("others"))).first()[0] or 0
    dealt = dealt.join(regions, "id").withColumn("other", F.explode("others"))
    first = F.when(F.col("other") < 0, F.col("mine")).when(F.col("mine") < 0, F.col("other")).otherwise(F.least("mine", "other"))
    second = F.when(F.col("other") < 0, F.col("other")).when(F.col("mine") < 0, F.col("mine")).otherwise(F.greatest("mine", "other"))
    dealt = dealt.select("bucket", "id", "comp", "regions", "mine", first.alias("i"), second.alias("j"))
    groups = int(n_bytes // GROUP_BYTES) + 1
    by = [F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)).alias("g"), "i", "j"]
    return materialize(dealt.groupBy(*by).applyInArrow(lambda table: _compare(least, table), "a long, b long").distinct(), "dart-more-links")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of one document of each class, that of the smallest doc_id, with all their columns.

    Rows that share an id share a class, and one of them stays, the one whose columns hash lowest; rows with a null id stay.
    """
    classes = materialize(near_duplicates(docs, least=least), "dart-kept")
    dropped = classes.filter("class_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(materialize(dropped, "dart-dropped"), "doc_id", "left_anti").select(docs.columns)
    named = classes.filter("doc_id is not null")
    if not named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        first = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
        kept = first.select("_row.*").unionByName(kept.filter("doc_id is null"))
    return kept
