"""Whitening of embeddings along their leading principal components.

Entries become whole numbers, floor(``SCALE`` * entry).  The fit list is each distinct
whole vector once, written as a table.  Its covariance V is never formed: block
Lanczos asks for V times a block of vectors, and a pass over the fit list gives that
product as the sum of the tasks' Xc'(Xc B), Xc being centred before it is multiplied.
Every new block is orthogonalised twice against all before it.  A direction in which
nothing is left (a breakdown) restarts from a random one.  The Ritz pairs come from the
products themselves, so their residuals are true ones; passes end when the residuals of
all wanted components are ``TOLERANCE`` of the greatest eigenvalue, or when the blocks span
the whole space.  V's trace is the sum of the exact deviations.

The driver holds blocks of (length of a vector) x (vectors so far) numbers and no row.
A pass reads the fit list once; what tasks send is summed by a shuffle before it
gets to the driver.

A null vector and one with null, infinite or NaN entries has no rows in the result, nor has one
of another length than most.  Entries beyond 2**62 / ``SCALE`` count as that number;
a deviation beyond 64 bits is null.  Components in which the fit list does not vary are
left out: a table of equal vectors gives no rows, as an empty one does.  Repeated and
null ids keep their rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name
from .vectors import as_cells, common_length, from_bytes, is_finite, matrix, summed_cells

SCALE, COMPONENTS, BLOCK = 256, 4, 8
TOLERANCE, SEED = 1e-13, 20_011
_FAR = 1 << 62


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) as 64-bit numbers."""
    return np.clip(np.floor(SCALE * vectors), -_FAR, _FAR).astype(np.int64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row, the exact sum of (n * x - sums)**2 over the dimensions; None beyond 64 bits."""
    if not len(x):
        return []
    most = n * int(np.abs(x).max()) + max(map(abs, sums))
    if most * most * x.shape[1] < _FAR:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in found]


class FitList:
    """The distinct whole vectors, as a table (x binary), with their number, sums and mean."""

    def __init__(self, rows: DataFrame, length: int, work: Scratch):
        self.length = length
        self.table = work.written(rows.select("x").distinct(), "fit")

        def sums(batches):
            for batch in batches:
                x = from_bytes(batch.column(0), np.int64, length)
                exact = x.sum(axis=0).tolist() if len(x) * int(np.abs(x).max(initial=0)) < _FAR else x.astype(object).sum(axis=0).tolist()
                # by halves of 32 bits, whose sums stay within 64 in any number of rows
                low, high = [v & 0xFFFFFFFF for v in exact], [v >> 32 for v in exact]
                yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([len(x)] * length, pa.int64())], ["dim", "low", "high", "n"])

        parts = self.table.mapInArrow(sums, "dim int, low long, high long, n long")
        found = {r["dim"]: r for r in parts.groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("low", "high", "n"))).collect()}
        self.n = int(found[0]["n"]) if found else 0
        self.sums = [int(found[i]["low"]) + (int(found[i]["high"]) << 32) for i in range(length)] if found else []
        self.mean = np.array([s / self.n for s in self.sums])

    def summed(self, partial, shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``partial(x)``, a matrix of ``shape``, over batches of the list."""
        length = self.length

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                total += partial(from_bytes(batch.column(0), np.int64, length))
            yield as_cells(total)

        return summed_cells(self.table.mapInArrow(run, "cell int, value double"), shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times ``block``: one pass."""
        mean = self.mean

        def partial(x):
            centred = x - mean
            return centred.T @ (centred @ block)

        return self.summed(partial, block.shape) / self.n

    def trace(self) -> float:
        n, sums = self.n, self.sums

        def partial(x):
            exact = deviations(x, n, sums)
            if None in exact:
                exact = ((x - np.array(sums, float) / n) ** 2).sum(axis=1) * float(n) ** 2
            return np.full((1, 1), float(np.sum(np.array(exact, float))))

        return float(self.summed(partial, (1, 1))[0, 0]) / self.n**3

    def identity_error(self, axes: np.ndarray) -> float:
        """The largest absolute entry of (covariance of the list's projections on ``axes``) minus the identity."""
        mean, k = self.mean, axes.shape[1]

        def partial(x):
            w = (x - mean) @ axes
            return np.vstack([w.sum(axis=0), w.T @ w])

        total = self.summed(partial, (k + 1, k)) / self.n
        return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def new_directions(block: np.ndarray, basis: np.ndarray, random: np.random.RandomState) -> np.ndarray:
    """``block`` made orthonormal to ``basis`` and in itself; what breaks down starts again from random vectors."""
    scale, found = np.linalg.norm(block, axis=0).max(initial=0.0), basis
    for column in block.T[: basis.shape[0] - basis.shape[1]]:
        for attempt in range(100):
            v = column if attempt == 0 else random.normal(size=len(column))
            size = scale if attempt == 0 else np.linalg.norm(v)
            for _ in range(2):
                v = v - found @ (found.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size:
                v = v / left
                v = v - found @ (found.T @ v)
                found = np.column_stack([found, v / np.linalg.norm(v)])
                break
    return found[:, basis.shape[1] :]


def block_lanczos(times, length: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greatest ``wanted`` eigenvalues of the symmetric ``times``, falling, with unit eigenvectors and residuals.

    Blocks have ``wanted`` vectors at least, so that an eigenvalue is found as often as it is repeated.
    """
    random = np.random.RandomState(seed)
    basis, image = np.zeros((length, 0)), np.zeros((length, 0))
    new = new_directions(random.normal(size=(length, min(max(block, wanted), length))), basis, random)
    while True:
        product = times(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:wanted], inner[:, ::-1][:, :wanted]
        vectors = basis @ inner
        residuals = np.linalg.norm(image @ inner - vectors * values, axis=0)
        converged = len(values) == min(wanted, length) and residuals.max() <= tolerance * max(values[0], 0.0)
        if converged or basis.shape[1] >= length:
            return values, vectors / np.linalg.norm(vectors, axis=0), residuals
        new = new_directions(product, basis, random)


def whitened_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    length = common_length(df, vec_col)
    usable = df.where(is_finite(F.col(vec_col)) & (F.size(vec_col) == length))
    rows = usable.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))

    def as_whole(batches):
        for batch in batches:
            x = whole(matrix(batch.column(1), length))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "x"])

    rows = rows.mapInArrow(as_whole, f"id {dict(rows.dtypes)['id']}, x binary")
    work, n, sums, mean = Scratch(df.sparkSession, "whitening"), 0, [], np.zeros(length)
    values, axes, explained, error = np.zeros(0), np.zeros((length, 0)), np.zeros(0), 0.0
    try:
        fit = FitList(rows, length, work)
        n, sums, mean = fit.n, fit.sums, fit.mean
        if n > 1:
            trace = fit.trace()
            values, vectors, _ = block_lanczos(fit.times, length, components, block, tolerance)
            varies = values > trace * 1e-12
            values, axes = values[varies], vectors[:, varies] / np.sqrt(values[varies])
            explained = values / trace
            error = fit.identity_error(axes) if len(values) else 0.0
    finally:
        work.clear()
    k = len(values)

    def project(batches):
        for batch in batches:
            x = from_bytes(batch.column(1), np.int64, length)
            w, places = (x - mean) @ axes, np.repeat(np.arange(len(x)), k)
            exact = np.array(deviations(x, n, sums) if k else [], object)[places] if k else []
            columns = [batch.column(0).take(pa.array(places)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([n] * len(places), pa.int64()), pa.array(list(exact), pa.int64())]
            columns += [pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(places), error))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *names])

    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(project, schema).withColumnRenamed("id", free_name(names, id_col))
