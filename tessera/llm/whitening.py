"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred rows. A step takes a direction v to u = Xv less the earlier left vectors, and u to Xᵀu less the earlier right
ones. Left vectors are as long as the table and are never stored: each is X times a short vector w that the driver knows, so a task
makes its part of u from the rows at hand, and both products of a step are one scan. Full reorthogonalisation keeps the
recurrence true: against right vectors by their own coefficients, twice; against left vectors by Uᵀu = Wᵀ(Xᵀu), which needs no further scan.
The small bidiagonal matrix is decomposed on the driver; as many steps as dimensions give every component.

The driver holds a few square matrices of the dimension, tasks hold a batch of rows; sums over tasks are one aggregate.

Cases: rows whose vector is null, empty, holds null or non-finite entries, or is of another length than most (the shorter on a tie) are dropped;
null and repeated ids stay as they are; components without deviation, of which there are some where the rows span fewer than 32 dimensions, are left out, so a
table of equal rows and an empty table give no rows; deviation is exact, and null where it does not fit a long; entries beyond
2**30 count as 2**30, with their sign; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, read

#: Fixed-point form of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: The largest entry; keeps sums of 100 million of the largest inside a long.
LARGEST = 1 << 30
COMPONENTS = 32


def fixed_point(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x array<long> of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    good = rows.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)).select("vec_id", F.transform(v, lambda c: F.floor(F.greatest(F.least(c, F.lit(float(LARGEST))), F.lit(-float(LARGEST))) * SCALE) + SHIFT).alias("x"))
    most = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    return good.join(F.broadcast(most.select("d")), F.size("x") == F.col("d")).select("vec_id", "x")


def matrix(batch) -> np.ndarray:
    """The vectors of an Arrow batch as rows of integers."""
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(table: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of part(rows of a batch); a task sends one row of `width` numbers."""
    where = np.int64 if kind == "long" else float

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(width, where)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch))
        yield pa.record_batch([pa.array([x]) for x in total], names=[f"s{j}" for j in range(width)])

    parts = table.select("x").mapInArrow(run, ", ".join(f"s{j} {kind}" for j in range(width)))
    return np.array([x or 0 for x in parts.agg(*(F.sum(f"s{j}") for j in range(width))).first()], where)


class Bidiagonal:
    """Right vectors, short vectors of the left ones and the coefficients of a bidiagonalisation, one step at a time."""

    def __init__(self, apply: Callable[[np.ndarray], np.ndarray], d: int, seed: int = 12):
        """apply(w) gives [|Xw|², Xᵀ(Xw)] by one scan."""
        self.apply, self.d, self.rng = apply, d, np.random.default_rng(seed)
        self.v, self.w, self.g = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # right vectors, U = XW, and XᵀU
        self.alpha, self.beta = [], []

    def _new(self, r: np.ndarray) -> tuple[np.ndarray, float]:
        """r orthogonal to the right vectors and of unit length, and its length before; a random direction where nothing is left of r."""
        size = np.linalg.norm(r)
        for _ in range(2):
            r = r - self.v @ (self.v.T @ r)
        left = float(np.linalg.norm(r))
        if left > 1e-13 * max(size, self.scale):
            return r / left, left
        r = self.rng.standard_normal(self.d)
        for _ in range(3):
            r = r - self.v @ (self.v.T @ r)
            r /= np.linalg.norm(r)
        return r, 0.0

    @property
    def scale(self) -> float:
        return max([1e-300, *self.alpha])

    def run(self) -> None:
        v, beta = self._new(self.rng.standard_normal(self.d))
        for k in range(self.d):
            self.v = np.column_stack([self.v, v])
            w = v - beta * self.w[:, -1] if k else v
            square, g = (lambda s: (s[0], s[1:]))(self.apply(w))
            size = np.sqrt(square)
            c = self.w.T @ g  # what u holds of the earlier left vectors
            w, g = w - self.w @ c, g - self.g @ c
            alpha = float(np.sqrt(max(square - c @ c, 0)))
            if alpha <= 1e-12 * max(size, self.scale):  # v adds nothing: a left vector of zeros
                alpha, w, g = 0.0, np.zeros(self.d), np.zeros(self.d)
            else:
                w, g = w / alpha, g / alpha
            self.alpha.append(alpha)
            self.w, self.g = np.column_stack([self.w, w]), np.column_stack([self.g, g])
            if k + 1 < self.d:
                v, beta = self._new(g - alpha * self.v[:, -1])
                self.beta.append(beta)

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """Deviations (singular values of X) in falling order and the unit vectors of the components, as columns."""
        b = np.diag(self.alpha) + np.diag(self.beta, 1)
        _, s, q = np.linalg.svd(b)
        return s, self.v @ q.T


def whiten(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    table = durable(fixed_point(rows, vector), "whitening")
    schema = f"vec_id {dict(table.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    first = table.select(F.size("x")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = int(first[0])
    sums = summed(table, lambda x: np.append(x.sum(0), len(x)), d + 1, "long")
    n, total = int(sums[-1]), sums[:-1]

    def centred(x: np.ndarray) -> np.ndarray:
        if n * float(np.abs(x).max(initial=0)) >= 2.0**62:
            return x - total / n
        return (n * x - total) / n  # exact integers before the division

    def products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        c = centred(x)
        u = c @ w
        return np.append(u @ u, u @ c)

    made = Bidiagonal(lambda w: summed(table, lambda x: products(x, w), d + 1), d)
    made.run()
    s, q = made.components()
    e = s * s / n
    kept = int(min(most, (s > 1e-10 * max(s[0], 1e-300)).sum())) if s[0] > 0 else 0
    if not kept:
        return rows.sparkSession.createDataFrame([], schema)
    basis, explained = q[:, :kept] / np.sqrt(e[:kept]), e[:kept] / e.sum()
    pair = lambda x: (lambda y: np.append((y.T @ y).ravel(), y.sum(0)))(centred(x) @ basis)
    moments = summed(table, pair, kept * (kept + 1))
    mean = moments[kept * kept :] / n
    error = float(np.abs(moments[: kept * kept].reshape(kept, kept) / n - np.outer(mean, mean) - np.eye(kept)).max())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch)
            y, away = centred(x) @ basis, n * x - total
            fits = ((n * x.astype(float) - total) ** 2).sum(1) < 2.0**62.9
            deviation = np.repeat((away * away).sum(1), kept)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), kept)))
            columns = [np.tile(np.arange(1, kept + 1, dtype=np.int32), m), np.full(m * kept, n), pa.array(deviation, mask=np.repeat(~fits, kept)), y.ravel(), np.tile(explained, m), np.full(m * kept, error)]
            yield pa.record_batch([ids, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return bound_batches(table).select("vec_id", "x").mapInArrow(run, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
