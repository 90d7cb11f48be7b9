"""Exact top-k by integer inner product with block-at-a-time pruning.

Vectors are cut into blocks of neighbouring documents. Each block keeps its forward index (the vectors, term by term)
and, for every term (component), the largest and smallest value. A query's bound for a block is the sum over terms of
the larger of q*max and q*min. Blocks are taken by falling bound; the first ones are scored whole, which sets the k-th
score. The others are scored through the forward index a few terms at a time, the query's heaviest first, while the sum
of what the block's best document has so far and of the other terms' maxima is not below the k-th score. A block whose
bound falls below it is left, most often long before its last term, and at once where vectors lie in clusters.

Placement. Within each input partition, vectors are ordered by halving along the widest component so that blocks are
tight; no shuffle is needed for that. Blocks are dealt to segments, queries to groups, both of bounded size; every pair
of a segment and a group is one unit of work, and the k best of each unit are merged by a window per query. A query and
a document meet in one unit only, so work is quadratic as any all-queries search, and memory is not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import materialize

BLOCK = 32  # vectors in a block
UNIT = 32  # blocks in a row, the grain in which blocks are dealt
STEP = 4  # terms scored before a bound is looked at again
WIDEST = 9223372036854774784.0  # the largest double below 2**63


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) with x as double; vectors null or with null or non-finite parts go.

    Components whose integers would not fit 64 bits are held at their ends. Rows with a null key go; repeated rows stay.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(WIDEST)), F.lit(-WIDEST)))
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, whole).alias("v"))


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    wide = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def tight_order(m: np.ndarray, least: int = BLOCK) -> np.ndarray:
    """An order of the rows in which blocks of `least` lie close: halves at the middle of the widest component, again and again."""
    order = np.arange(len(m))
    todo = [(0, len(m))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= least:
            continue
        part = m[order[lo:hi]].astype(np.float64)
        wide = part.max(0) - part.min(0)
        at = int(np.argmax(wide)) if len(wide) else 0
        if not len(wide) or wide[at] == 0:
            continue
        middle = max(least, (hi - lo) // 2 // least * least)
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, at], middle - 1)]
        todo += [(lo, lo + middle), (lo + middle, hi)]
    return order


def _packed(batches: Iterator[pa.RecordBatch], rows: int, ordered: bool) -> Iterator[pa.RecordBatch]:
    """Rows of up to `rows` vectors as (ids, values, width) in binary form."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids = whole.column("vec_id").to_numpy()
        m = _matrix(whole.column("v").chunk(0) if whole.num_rows else pa.array([], pa.list_(pa.int64())))
        if ordered and m.size:
            order = tight_order(m)
            ids, m = ids[order], m[order]
        parts = [(ids[i : i + rows].tobytes(), m[i : i + rows].tobytes(), m.shape[1]) for i in range(0, len(ids), rows)]
        if parts:
            a, b, c = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int32())], ["ids", "vals", "width"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 65_536:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    wide = int(pdf["width"].max())
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    rows = []
    for x, w, i in zip(pdf["vals"], pdf["width"], pdf["ids"], strict=True):
        m = np.frombuffer(x, np.int64).reshape(len(i) // 8, w)
        rows.append(np.pad(m, ((0, 0), (0, wide - w))))
    return ids, np.concatenate(rows)


class Work(NamedTuple):
    """Blocks met by queries, those left at their first bound, those left on the way, and products of a query's and a document's term."""

    met: int
    left_at_once: int
    left_on_the_way: int
    products: int
    all_products: int

    @property
    def share_left(self) -> float:
        """Blocks that were not scored to their end."""
        return (self.left_at_once + self.left_on_the_way) / max(1, self.met)

    @property
    def share_saved(self) -> float:
        return 1 - self.products / max(1, self.all_products)


class Blocks:
    """Documents cut into blocks, with forward indexes by term and each term's largest and smallest value by block."""

    def __init__(self, ids: np.ndarray, d: np.ndarray, largest_query: float, block: int = BLOCK):
        # Sums of products are exact in floating point below 2^53; beyond, they are taken in Python's integers.
        exact = float(np.abs(d.astype(np.float64)).max(initial=0)) * largest_query * max(1, d.shape[1]) < 2**53
        self.kind = np.float64 if exact else object
        self.ids, self.block, self.n = ids, block, len(d)
        self.starts = np.arange(0, len(d), block)
        whole = d.astype(self.kind)
        if short := -len(d) % block:  # the last block is filled by copies of its last document, which are never taken
            whole = np.concatenate([whole, np.repeat(whole[-1:], short, 0)])
        cells = whole.reshape(len(self.starts), block, d.shape[1])
        self.top, self.bottom = cells.max(1), cells.min(1)
        self.by_term = np.ascontiguousarray(cells.transpose(2, 0, 1))  # terms, blocks, documents

    def search(self, q_id: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, int]], np.ndarray]:
        """([(score, document)] of the k best, [blocks left at once, left on the way, products]) of one query."""
        q = q.astype(self.kind)
        terms = np.argsort(-np.abs(q.astype(np.float64)), kind="stable")
        q = q[terms]
        most = np.where(q > 0, q * self.top[:, terms], q * self.bottom[:, terms])  # by block and term
        rest = np.concatenate([np.cumsum(most[:, ::-1], 1)[:, ::-1], np.zeros((len(most), 1), self.kind)], 1)
        order = np.argsort(-rest[:, 0].astype(np.float64), kind="stable")
        best: list[tuple[int, int]] = []
        work = np.zeros(3, np.int64)

        def take(blocks: np.ndarray, scores: np.ndarray) -> None:
            """Merge the scores of these blocks' documents into the best."""
            nonlocal best
            at = (self.starts[blocks][:, None] + np.arange(self.block)).ravel()
            s, real = scores.ravel(), at < self.n
            real[real] = self.ids[at[real]] != q_id
            at, s = at[real], s[real]
            if len(best) == k and len(s):
                near = s >= best[-1][0]
                at, s = at[near], s[near]
            if len(s) > 4 * k:  # only scores among the k highest, with all ties
                near = s >= np.partition(s, len(s) - k)[len(s) - k]
                at, s = at[near], s[near]
            found = [(int(x), int(i)) for x, i in zip(s.tolist(), self.ids[at].tolist(), strict=True)]
            best = sorted([*best, *found], key=lambda t: (-t[0], t[1]))[:k]

        # The first blocks, until k documents are known, and as many again, give the k-th score.
        lead = max(1, min(len(order), 2 * math.ceil((k + 1) / self.block)))
        first, live = order[:lead], order[lead:]
        scores = sum((x * self.by_term[t, first] for x, t in zip(q, terms, strict=True)), np.zeros((len(first), self.block), self.kind))
        work[2] += scores.size * len(q)
        take(first, scores)
        least = lambda: best[-1][0] if len(best) == k else None
        if (bar := least()) is not None:
            # A block whose bound equals the k-th score may still hold a smaller id.
            open_ = rest[live, 0] >= bar
            work[0] += int((~open_).sum())
            live = live[open_]
        so_far, step = np.zeros((len(live), self.block), self.kind), 0
        while len(live) and step < len(q):
            more = range(step, min(step + STEP, len(q)))
            for c in more:
                so_far += q[c] * self.by_term[terms[c], live]
            work[2] += so_far.size * len(more)
            step += len(more)
            if step < len(q) and (bar := least()) is not None:
                open_ = so_far.max(1) + rest[live, step] >= bar
                work[1] += int((~open_).sum())
                live, so_far = live[open_], so_far[open_]
        if len(live):
            take(live, so_far)
        return best, work


def search_blocks(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, block: int = BLOCK) -> tuple[list[tuple[int, int, int]], Work]:
    """((query, document, score) of the k best of each query among these documents, what it took); scores are held within 64 bits."""
    wide = max(q.shape[1], d.shape[1])
    q, d = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (q, d))
    held = Blocks(d_ids, d, float(np.abs(q.astype(np.float64)).max(initial=0)), block)
    found, total = [], np.zeros(3, np.int64)
    for q_id, row in zip(q_ids.tolist(), q, strict=True):
        best, work = held.search(q_id, row, k)
        total += work
        found += [(q_id, i, min(max(s, -(2**63)), 2**63 - 1)) for s, i in best]
    met = len(q) * len(held.starts)
    return found, Work(met, int(total[0]), int(total[1]), int(total[2]), met * block * wide)


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, segment: int | None = None, group: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest inner product, ties to the smaller vec_id.

    Both inputs are (vec_id, v array<long>), as integer_vectors makes them. Every row is a candidate, repeated ones
    too, but for rows of the query's own id; the scores of query rows that share an id are ranked together. Fewer than
    k candidates give fewer rows; vectors of different widths meet as if filled with zeros, and an empty vector
    scores 0. Scores beyond 64 bits are held at their ends. segment and group bound the vectors of a unit of work;
    by default they follow the sizes between fixed limits, which changes no result. Empty inputs give no rows.
    """
    pack = lambda df, rows, ordered: df.select("vec_id", "v").mapInArrow(lambda it: _packed(it, rows, ordered), "ids binary, vals binary, width int")
    docs = materialize(pack(candidates, BLOCK * UNIT, True), "topk-blocks")
    asked = materialize(pack(queries, 256, False), "topk-queries")
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0)).cast("long")).first()[0]
    n_docs, n_asked = size(docs), size(asked)
    segment = segment or min(65_536, max(4_096, n_docs // 24))
    group = group or min(16_384, max(512, n_asked // 4))
    segments, groups = max(1, math.ceil(n_docs / segment)), max(1, math.ceil(n_asked / group))
    part = lambda df, n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    docs = docs.select("*", part(docs, segments).alias("seg"), all_of(groups).alias("grp"))
    asked = asked.select("*", part(asked, groups).alias("grp"), all_of(segments).alias("seg"))

    def unit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            d_ids, d = _unpack(left)
            q_ids, q = _unpack(right)
            found, _ = search_blocks(q_ids, q, d_ids, d, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = docs.groupBy("seg", "grp").cogroup(asked.groupBy("seg", "grp")).applyInPandas(unit, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
