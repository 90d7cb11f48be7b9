"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of their centred rows.

The rows X stay where they lie. A step multiplies them by a vector on one side, Xv, and by what that gives on the other,
X'u; both products are sums over rows that tasks make for their share, so that numbers by dimension alone move. Long vectors
u are never stored: u = Xw for a short w, so each task makes the entries of all u for its rows when it needs them, and full
reorthogonalisation of u is done on w with the products that the tasks have summed; short vectors v are reorthogonalised on
the driver. The singular values of the small bidiagonal matrix give deviations, its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
AGAIN = 0.7  # what must be left of a vector's length after reorthogonalisation, else it is done once more
GONE = 1e-13  # share of the largest singular value that counts as none
LARGEST = float(1 << 40)  # entries beyond this in size have no whole number that sums stay exact with
SEED = 7


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): rows of finite vectors with x = floor(1024 c) + 100000 by entry.

    A null vector, or one with a null or non-finite entry, takes no part; nor does one with an entry beyond 2^40 / 1024 in
    size, or one of another number of entries than most have (the longer of two as frequent). Empty vectors are dropped.
    """
    c = F.col(vector)
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) * SCALE < LARGEST) & ~F.isnan(v))
    rows = vectors.select(key, vector).filter(F.coalesce(usable, F.lit(False)))
    rows = rows.select(key, F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("x") == (most["d"] if most else 0))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """A column of lists of equal length as a matrix of whole numbers."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


class Centre(NamedTuple):
    """What centring needs: the number of rows and the sums by dimension, both exact."""

    n: int
    sums: np.ndarray

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact in whole numbers of Python where 64 bits might not hold them."""
        if self.n * max(1, int(np.abs(x).max(initial=0))) < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, as the rounded quotient of exact numbers."""
        return self.offsets(x).astype(np.float64) / self.n


def centre(rows: DataFrame) -> Centre:
    """Exact sums by dimension; one row a dimension comes to the driver."""
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted((r["i"], int(r["s"]), r["n"]) for r in each.collect())
    return Centre(found[0][2] if found else 0, np.array([s for _, s, _ in found], dtype=object))


def summed(rows: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what part makes of a block of them: size numbers a task, added up by place before the driver gets them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    sums = rows.select("x").mapInArrow(task, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in sums.collect():
        out[r["i"]] = r["v"]
    return out


class Factors(NamedTuple):
    """Bidiagonal factors: X V = U B with orthonormal V and U = X W; alpha on the diagonal of B, beta above it."""

    v: np.ndarray
    w: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray


def bidiagonalise(rows: DataFrame, mid: Centre, steps: int | None = None) -> Factors:
    """Golub-Kahan-Lanczos steps from a fixed start; one pass over the rows a step, and one more where a vector had to be cleaned twice.

    Without steps there are as many as dimensions, after which B holds all of X. Where X'u lies within the space of the
    earlier v, the next v is a new direction beside them, and where Xv lies within that of the earlier u, u is none: rows of
    lower rank, equal rows and a single row end so.
    """
    d = len(mid.sums)
    steps = min(steps or d, d)
    rng = np.random.default_rng(SEED)
    v, w, z = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # z holds X'u by column
    alpha, beta = np.zeros(steps), np.zeros(max(0, steps - 1))
    largest, r = 0.0, rng.standard_normal(d)
    for k in range(steps):
        for _ in range(2):
            r = r - v @ (v.T @ r)
        v = np.column_stack([v, r / np.linalg.norm(r)])
        step = v[:, k] - (beta[k - 1] * w[:, k - 1] if k else 0)
        for again in range(3):
            held, new = w.copy(), step.copy()

            def part(x: np.ndarray, held: np.ndarray = held, new: np.ndarray = new) -> np.ndarray:
                c = mid.rows(x)
                p = c @ new  # Xv, less what the last u has of it
                return np.concatenate([c.T @ p, (c @ held).T @ p, [p @ p]])  # X'p, U'p and the square of p

            sums = summed(rows, d + k + 1, part)
            back, along, square = sums[:d], sums[d : d + k], sums[-1]
            left = max(0.0, square - along @ along)
            step, back = step - w @ along, back - z @ along
            largest = max(largest, np.sqrt(square))
            if left >= AGAIN * square or np.sqrt(left) <= GONE * largest:
                break
        alpha[k] = np.sqrt(left) if np.sqrt(left) > GONE * largest else 0.0
        scale = 1 / alpha[k] if alpha[k] else 0.0
        w, z = np.column_stack([w, step * scale]), np.column_stack([z, back * scale])
        if k + 1 < steps:
            r = z[:, k] - alpha[k] * v[:, k]
            for _ in range(2):
                r = r - v @ (v.T @ r)
            length = np.linalg.norm(r)
            beta[k] = length if length > GONE * largest else 0.0
            r = r if beta[k] else rng.standard_normal(d)
    return Factors(v, w, alpha, beta)


class Whitening(NamedTuple):
    """Unit components by column with the eigenvalues of the covariance, falling, and the covariance's trace."""

    mid: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, over their deviations; NaN where a component has none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (self.mid.rows(x) @ self.components) / np.sqrt(self.values), np.nan)


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening:
    """Components of all rows; fewer where vectors have fewer dimensions. Equal rows have components of no deviation."""
    mid = centre(rows)
    if not mid.n:
        return Whitening(mid, np.zeros((0, 0)), np.zeros(0), 0.0)
    f = bidiagonalise(rows, mid)
    _, s, right = np.linalg.svd(np.diag(f.alpha) + np.diag(f.beta, 1))
    values = np.where(s > GONE * 10 * max(s[0], 0), s, 0.0) ** 2 / mid.n
    return Whitening(mid, (f.v @ right.T)[:, :most], values[:most], float(values.sum()))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, over components that vary; null without any."""
    k = int((model.values > 0).sum())
    if not k:
        return None
    mean = summed(rows, k, lambda x: model.project(x)[:, :k].sum(0)) / model.mid.n

    def part(x: np.ndarray) -> np.ndarray:
        p = model.project(x)[:, :k] - mean
        return (p.T @ p).ravel()

    return float(np.abs(summed(rows, k * k, part).reshape(k, k) / model.mid.n - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    Repeated rows count each; a null key is kept. A component of no variance explains 0 and its whitened value is null. The
    deviation is exact, and an error where it does not fit 64 bits. No usable vectors give no rows.
    """
    rows = materialize(whole_vectors(vectors, key, vector), "whitening")
    model = fit(rows, most)
    error, explained = identity_error(rows, model), [float(v) / model.trace if model.trace else 0.0 for v in model.values]
    kept = len(model.values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            off = model.mid.offsets(x)
            if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] >= 1 << 63:
                off = off.astype(object)
            deviation = pa.array((off * off).sum(1).tolist(), pa.int64())  # refuses what does not fit
            p = model.project(x).ravel()
            rest = [pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), deviation.take(pa.array(np.repeat(np.arange(len(x)), kept))), pa.array(p, mask=np.isnan(p))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.repeat(np.arange(len(x)), kept))), *rest], [key, "component", "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.mapInArrow(task, f"`{key}` {kind}, component int, deviation long, whitened double")
    shares = F.array(*(F.lit(e) for e in explained)).cast("array<double>")
    return out.select(key, "component", F.lit(model.mid.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
