"""Embedding whitening: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.common import written

#: Degree of the filter's polynomial, and vectors beside the wanted ones.
DEGREE, GUARD = 10, 16
#: A pair is certain when its residual is below this share of the largest eigenvalue.
CERTAIN = 2e-14
#: Eigenvalues below this share of the largest are no direction of the data.
RANK = 1e-11
#: Larger entries are cut to this.
LARGEST = 2.0**40


def scaled(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """`id` and `x`, the entries floor(64 c) + 1,000,000 as little-endian 64-bit integers, of all usable vectors."""
    slim = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("c"))
    usable = slim.filter("c is not null and size(c) > 0 and not exists(c, v -> v is null or isnan(v) or abs(v) = double('Infinity'))")
    usable = written(usable, "vectors")
    # One row per length.
    lengths = usable.groupBy(F.size("c").alias("d")).count().collect()
    d = max(lengths, key=lambda r: (r["count"], r["d"]))["d"] if lengths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                x = np.clip(np.floor(64 * c), -LARGEST, LARGEST).astype("<i8") + 1_000_000
                column = pa.array([row.tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), column], names=["id", "x"])

    kind = slim.schema["id"].dataType.simpleString()
    return written(usable.filter(F.size("c") == d).mapInArrow(run, f"id {kind}, x binary"), "scaled")


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            raw = b"".join(batch.column("x").to_pylist())
            yield batch, np.frombuffer(raw, "<i8").reshape(-1, d)


class Vectors:
    """The fit list, spread over the cluster: its size, sums, trace, and products with its covariance."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        width = rows.select(F.octet_length("x").alias("b")).limit(1).collect()
        self.d = d = width[0]["b"] // 8 if width else 0

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(d, "i8"), 0
            for _, x in _matrices(batches, d):
                total, n = total + x.sum(0), n + len(x)
            columns = [pa.array(np.arange(d)), pa.array(total), pa.array(np.full(d, n))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "total", "n"])

        # One row per dimension.
        found = rows.mapInArrow(sums, "i long, total long, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        found = found.orderBy("i").collect() if d else []
        self.n = found[0]["n"] if found else 0
        self.total = np.array([r["total"] for r in found], "i8")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean. The difference is taken in whole numbers, so that nothing is lost to the offset."""
        return (self.n * x - self.total) / self.n

    def summed(self, task, shape: tuple[int, int]) -> np.ndarray:
        """The sum over all tasks of what `task` makes of its centred matrices. One row per entry reaches the driver."""
        d, n, total = self.d, self.n, self.total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(shape)
            for _, x in _matrices(batches, d):
                held += task((n * x - total) / n)
            columns = [pa.array(np.arange(held.size)), pa.array(held.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "value"])

        parts = self.rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        out = np.zeros(shape)
        for at, value in parts.collect():
            out.flat[at] = value
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q: one pass over the data, centred before multiplying."""
        return self.summed(lambda x: x.T @ (x @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), (1, 1))[0, 0]) / self.n


def filtered(vectors: Vectors, q: np.ndarray, vq: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is small on [0, low], one pass per degree, scaled at `high`.

    `vq` is the covariance times q, as the last Rayleigh-Ritz step has it.
    """
    half = low / 2
    sigma = half / (high - half)
    tau = 2 / sigma
    y = (vq - half * q) * (sigma / half)
    before = q
    for _ in range(2, degree + 1):
        new = 1 / (tau - sigma)
        before, y = y, (vectors.times(y) - half * y) * (2 * new / half) - before * (sigma * new)
        sigma = new
    return y


def leading(vectors: Vectors, wanted: int, guard: int = GUARD, degree: int = DEGREE, seed: int = 0):
    """Eigenvalues (falling) and unit eigenvectors of the covariance, up to `wanted`.

    A block of random directions is filtered by a polynomial that damps all below the block's smallest Ritz value,
    orthogonalised, and turned to Ritz vectors, until each wanted residual is certain or rounding stops it. Where a
    filter makes less than a tenth of the residuals, the block grows by half; a block of all dimensions is exact.
    """
    d, random = vectors.d, np.random.default_rng(seed)
    wanted = min(wanted, d)
    q = np.linalg.qr(random.standard_normal((d, min(d, wanted + guard))))[0]
    last = np.inf
    while True:
        vq = vectors.times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(values[0], 0.0)
        kept = int((values[:wanted] > RANK * top).sum())
        worst = np.linalg.norm(vq - q * values, axis=0)[:kept].max(initial=0)
        stopped = worst > last / 2 and worst < 1e3 * CERTAIN * top
        if not kept or worst <= CERTAIN * top or q.shape[1] == d or stopped:
            return values[:kept], q[:, :kept]
        if worst > last / 10 and worst > 1e3 * CERTAIN * top:
            more = random.standard_normal((d, min(d, q.shape[1] * 3 // 2) - q.shape[1]))
            q, _ = np.linalg.qr(np.hstack([q, more]))
            last = np.inf
            if q.shape[1] == d:
                continue
            vq = vectors.times(q)
        last = worst
        low = max(values[-1], RANK * top)
        q, _ = np.linalg.qr(filtered(vectors, q, vq, low, top, degree))


def whiten(
    embeddings: DataFrame, components: int = 32, guard: int = GUARD, degree: int = DEGREE,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """One row per usable vector and component: its id, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Entries c become the whole numbers x = floor(64 c) + 1,000,000. The covariance of x is never made: each step is a
    distributed pass over centred vectors that returns one row per dimension and direction. `whitened` is the centred
    vector on the component's eigenvector over the root of its eigenvalue, `explained` that eigenvalue's share of the
    trace, `deviation` the exact sum of (n x - S)^2, and `identity_error` the largest entry of the covariance of
    all `whitened` less the identity, measured in a pass of its own.

    Vectors that are NULL, empty, hold NULL or are not finite are dropped, as are vectors of another length than the
    most frequent one (of equally frequent lengths the longest). Equal vectors count as often as they occur; ids are
    passed through, NULL and repeated ones too. Directions without variance are no components: equal vectors, or a
    single one, have no rows, and neither have empty tables. Entries are cut at 2^34 in size; `deviation` is exact while
    it is below 2^63. Other columns are left out.
    """
    rows = scaled(embeddings, id_col, vec_col)
    vectors = Vectors(rows)
    d, n, total = vectors.d, vectors.n, vectors.total
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    values, q = leading(vectors, components, guard, degree) if n else (np.zeros(0), np.zeros((0, 0)))
    k = len(values)
    onto = q / np.sqrt(values) if k else q
    explained = values / vectors.trace() if k else values
    error = 0.0
    if k:
        # The last row sums the whitened vectors themselves, whose mean is not quite zero.
        def spread(x: np.ndarray) -> np.ndarray:
            z = x @ onto
            return np.vstack([z.T @ z, z.sum(0)])

        moments = vectors.summed(spread, (k + 1, k)) / n
        error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, d):
            for at in range(0, len(x) if k else 0, 1024):
                apart = n * x[at:at + 1024] - total
                b = len(apart)
                z = (apart / n) @ onto
                columns = [
                    batch.column("id").slice(at, b).take(pa.array(np.repeat(np.arange(b), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), b)), pa.array(np.full(b * k, n, "i8")),
                    pa.array(np.repeat((apart * apart).sum(1), k)), pa.array(z.ravel()),
                    pa.array(np.tile(explained, b)), pa.array(np.full(b * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
