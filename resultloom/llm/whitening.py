"""Whitening of vectors: principal components of a distributed covariance, refined in higher precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultloom.llm.vectors import finite, matrix, packed
from resultloom.runtime import materialize

COMPONENTS = 16
# An entry c becomes floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
# Vectors handled at once in a task.
PIECE_ROWS = 8192
ROUNDS = 12


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of Ogita and Aishima (2018): (eigenvalues, vectors, bound below which gaps are clusters).

    ``x`` has approximate eigenvectors of the symmetric ``a`` as columns. Four matrix products in
    the precision of ``a`` give their correction, which squares the error of well separated vectors;
    columns whose eigenvalues cannot be told apart yet are only made orthogonal.
    """
    rest = np.eye(len(a), dtype=a.dtype) - x.T @ x
    small = x.T @ (a @ x)
    values = np.diag(small) / (1 - np.diag(rest))
    size = lambda m: np.linalg.norm(m.astype(np.float64), 2)
    # Gaps that a double does not resolve stay clusters, however good the vectors.
    bound = max(2 * (size(small - np.diag(values)) + size(a) * size(rest)), np.finfo(np.float64).eps * size(a))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    step = np.where(apart, (small + values[None, :] * rest) / np.where(apart, gap, 1), rest / 2)
    return values, x + x @ step, bound


def clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Positions of eigenvalues that follow each other within ``bound``, two or more together."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def eigen(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Starts from the eigenvectors in float32. Each round makes one refining step in extended
    precision; eigenvalues within its bound of each other are a cluster, whose own small problem, shifted
    by their mean, is solved and turns the vectors of the cluster before the next step. Signs: the
    largest entry of a vector is positive.
    """
    scale = float(np.abs(a).max()) or 1.0
    a = np.asarray(a, np.longdouble) / scale
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    least = np.finfo(np.float64).eps * len(a)
    identity = np.eye(len(a), dtype=np.longdouble)
    for _ in range(rounds):
        values, x, bound = refine(a, x)
        for group in clusters(values, bound):
            own = x[:, group]
            middle = values[group].mean()
            inner = own.T @ (a @ own) - middle * (own.T @ own)
            x[:, group] = own @ np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1].astype(np.longdouble)
        if bound < least:
            break
    for _ in range(2):
        x = x + x @ (identity - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def _clean(steps: int, shift: int):
    def run(batches):
        for batch in batches:
            keep, sizes, entries = finite(batch.column("embedding"))
            whole = np.floor(steps * entries)
            # What no long can hold is no finite entry either.
            fits = np.logical_and.reduceat(np.abs(whole) < 2.0**62, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(sizes) else np.zeros(0, bool)
            whole, at = whole[np.repeat(fits, sizes)].astype(np.int64) + shift, np.flatnonzero(keep)[fits]
            yield pa.record_batch(
                [batch.column("vec_id").take(pa.array(at)), pa.array(sizes[fits].astype(np.int32)), packed(whole, sizes[fits])], names=["vec_id", "size", "vector"]
            )

    return run


def _parts(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(low, PIECE_ROWS)


def _sums(batches):
    """Per task: rows, and per dimension the sum in two parts that no long overflows."""
    n, high, low = 0, 0, 0
    for batch in _parts(batches):
        x = matrix(batch.column("vector"))
        n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & (2**31 - 1)).sum(axis=0)
    if n:
        yield pa.record_batch([pa.array([n]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], names=["n", "high", "low"])


def _matrix_rows(total):
    if not np.isscalar(total):
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])


def _products(centre: list[int]):
    """Per task: the rows of the sum of products of the vectors less ``centre``."""

    def run(batches):
        middle, total = np.array(centre, np.int64), 0
        for batch in _parts(batches):
            y = (matrix(batch.column("vector")) - middle).astype(np.float64)
            total = total + y.T @ y
        yield from _matrix_rows(total)

    return run


def _added(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(r, np.float64) for r in group.column("row").to_pylist()], axis=0)
    return pa.table([group.column("i").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["i", "row"])


def _gathered(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' matrices, added up row by row in Spark."""
    rows = parts.groupBy("i").applyInArrow(_added, "i int, row binary").collect()
    return np.array([np.frombuffer(r.row, np.float64) for r in sorted(rows, key=lambda r: r.i)])


class Map:
    """From vectors of longs to whitened ones: (x - sums / n) on each component, over the root of its eigenvalue."""

    def __init__(self, n: int, sums: list[int], centre: list[int], values: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.centre, self.rest = n, centre, [s - n * c for s, c in zip(sums, centre)]
        self.weights = vectors / np.sqrt(values)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        y = (x - np.array(self.centre, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return y @ self.weights

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - sums)^2 of each row, exact; null where it is no long."""
        y = x - np.array(self.centre, np.int64)
        if len(y) and (self.n * float(np.abs(y).max()) + self.n) ** 2 * y.shape[1] < 2.0**62:
            return pa.array(((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1))
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in y.tolist()]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def _moments(model: Map):
    """Per task: the rows of the sum of products of the whitened vectors, each with a last entry of one."""

    def run(batches):
        total = 0
        for batch in _parts(batches):
            z = model.whiten(matrix(batch.column("vector")))
            z = np.column_stack([z, np.ones(len(z))])
            total = total + z.T @ z
        yield from _matrix_rows(total)

    return run


def _rows(model: Map, explained: list[float], error: float):
    def run(batches):
        k = len(explained)
        for batch in _parts(batches):
            x = matrix(batch.column("vector"))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n, np.int64)), model.deviations(x).take(each), pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, steps: int = STEPS, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    ``vectors`` has vec_id and embedding; an entry c becomes x = floor(``steps`` * c) + ``shift``. The fit is over the
    distinct x vectors, n of them with sums S: their covariance (divisor n) is added up in tasks as
    products of x less a whole number next to S / n, so that nothing large cancels, and its
    eigenvectors are found as ``eigen`` says. Only sums of one number a dimension and a matrix of dimensions squared
    reach the driver. ``deviation`` is the exact sum of (n * x - S)^2, null where it is no long; ``whitened``
    the row less S / n on the component, over the root of its eigenvalue; ``explained`` the share of the
    trace; ``identity_error`` the largest absolute entry of the whitened fit vectors' covariance less the
    identity, measured by a further pass over them.

    Rows with a null or empty vector, a null or non-finite entry or one whose x is no long are dropped, and so
    are those of another length than most vectors have (of equally frequent ones the longest). Null
    ids and repeated rows stay, and repeated vectors count once in the fit. Components without variance are
    not returned, so a single distinct vector, or an empty table, gives no rows.
    """
    spark = vectors.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_clean(steps, shift), "vec_id long, size int, vector binary")
    rows = materialize(rows, "vectors")
    width = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if width is None:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.col("size") == width["size"])
    fit = materialize(rows.select("vector").distinct(), "fit")
    totals = fit.mapInArrow(_sums, "n long, high array<long>, low array<long>").select(
        "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s")
    ).select("i", "n", "s.high", "s.low")
    totals = totals.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()
    n = int(totals[0]["n"])
    sums = [(int(t["high"]) << 31) + int(t["low"]) for t in totals]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * c) / n for s, c in zip(sums, centre)])
    covariance = _gathered(fit.mapInArrow(_products(centre), "i int, row binary")) / n - np.outer(rest, rest)
    values, axes = eigen(covariance)
    trace = float(np.trace(covariance))
    live = min(components, int((values > np.finfo(np.float64).eps * len(values) * max(trace, 0.0)).sum()))
    if not live:
        return spark.createDataFrame([], out)
    model = Map(n, sums, centre, values[:live], axes[:, :live])
    moments = _gathered(fit.mapInArrow(_moments(model), "i int, row binary")) / n
    mean = moments[-1, :-1]
    error = float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(live)).max())
    return rows.mapInArrow(_rows(model, (values[:live] / trace).tolist(), error), out)
