"""Whitening of embedding vectors by their principal components.

The centred scatter of all different vectors is added up in tasks. The driver diagonalises this one small matrix by
cyclic Jacobi rotations, which give small eigenvalues as accurately as large ones, and the whitening
matrix goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebeam.llm.common import drop, stage
from cuebeam.llm.vectors import usable

#: A component x of a vector becomes floor(SCALE * x) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rotations go over all pairs so often at most. Convergence is quadratic: some ten times are enough.
MOST_SWEEPS = 60
#: Rows that a task holds as a matrix at once.
CHUNK_ROWS = 4096
#: Size from which a scaled component is no longer exact in double precision.
TOO_LARGE = float(1 << 52)


def jacobi(matrix):
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues.

    A sweep rotates every pair of rows and columns once, n / 2 disjoint pairs at a time. Sweeps end when each
    off-diagonal entry is below rounding of the root of its two diagonal entries' product, so that small
    eigenvalues are as accurate as large ones.
    """
    import numpy as np

    a = np.array(matrix, float)
    n = len(a)
    vectors = np.eye(n)
    if n < 2:
        return np.diag(a).copy(), vectors
    ring = np.arange(n + n % 2)  # with a bye where n is odd
    for _ in range(MOST_SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            p, q = np.minimum(ring[:half], ring[:half - 1:-1]), np.maximum(ring[:half], ring[:half - 1:-1])
            ring = np.r_[ring[0], ring[-1], ring[1:-1]]  # all meet all others once a sweep
            p, q = p[q < n], q[q < n]
            off, x, y = a[p, q], a[p, p], a[q, q]
            on = np.abs(off) > np.finfo(float).eps * np.sqrt(np.maximum(x, 0) * np.maximum(y, 0))
            if not on.any():
                continue
            turned = True
            p, q, off, x, y = p[on], q[on], off[on], x[on], y[on]
            # theta overflows to infinity where off is tiny: no rotation is left then
            with np.errstate(over="ignore"):
                theta = (y - x) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rows = a[p], a[q]
            a[p], a[q] = c[:, None] * rows[0] - s[:, None] * rows[1], s[:, None] * rows[0] + c[:, None] * rows[1]
            columns = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * columns[0] - s * columns[1], s * columns[0] + c * columns[1]
            a[p, p], a[q, q] = x - t * off, y + t * off
            a[p, q] = a[q, p] = 0.0
            own = vectors[:, p], vectors[:, q]
            vectors[:, p], vectors[:, q] = c * own[0] - s * own[1], s * own[0] + c * own[1]
        if not turned:
            break
    else:
        raise RuntimeError("rotations did not settle")
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    return values[order], vectors / np.linalg.norm(vectors, axis=0)


@dataclass(frozen=True)
class Whitening:
    """What whitens vectors of one length: n and sums of the fit list, matrix (a column a component) and share of the variance."""

    n: int
    sums: object
    matrix: object
    explained: object


def _matrices(batches: Iterator, column: int) -> Iterator:
    """(batch, rows of it, matrix) of the vectors of each length, some rows at a time."""
    import numpy as np

    for b in batches:
        for lo in range(0, b.num_rows, CHUNK_ROWS):
            part = b.slice(lo, CHUNK_ROWS)
            x = part.column(column)
            size = np.diff(x.offsets.to_numpy())
            flat = x.flatten().to_numpy()
            start = np.cumsum(size) - size
            for d in np.unique(size[size > 0]):
                at = np.flatnonzero(size == d)
                yield part, at, flat[start[at][:, None] + np.arange(d)]


def _added(parts: DataFrame) -> dict:
    """Sums of partial rows (dims, k, values as doubles), by dims and k; each is added up in a task."""
    import numpy as np

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for d, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = np.frombuffer(v.as_buffer(), float)
                sums[d, k] = sums[d, k] + own if (d, k) in sums else own.copy()
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["dims", "k", "sum"])

    rows = parts.repartition("dims", "k").mapInArrow(add, "dims int, k int, sum binary").collect()
    return {(r["dims"], r["k"]): np.frombuffer(r["sum"], float) for r in rows}


def _partial(rows: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.int32()), pa.array([v.tobytes() for v in rows.values()], pa.binary())], names=["dims", "k", "values"])


PARTS = "dims int, k int, values binary"


def fit(different: DataFrame, components: int = 16) -> tuple[dict[int, Whitening], float]:
    """The whitening of each length of the different vectors (x: array of longs), and the identity error.

    Two passes gather a vector of sums and the centred scatter, d numbers and d * d of each length d, whatever the number
    of vectors; a third measures how far the covariance of what is whitened is from the identity.
    Directions without variance are no components.
    """
    import numpy as np

    totals = different.select(F.size("x").alias("dims"), F.posexplode("x").alias("k", "value")).groupBy("dims", "k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("sum")).collect()
    count: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in sorted(totals, key=lambda r: (r["dims"], r["k"])):
        count[r["dims"]] = r["n"]
        sums.setdefault(r["dims"], []).append(int(r["sum"]))
    mean = {d: _mean(sums[d], count[d]) for d in count}

    def scatter(batches: Iterator) -> Iterator:
        own: dict = {}
        for _, _, x in _matrices(batches, 0):
            d = x.shape[1]
            c = _centred(x, mean[d])
            own[d] = own.get(d, 0) + c.T @ c
        yield _partial({(d, k): row for d, m in own.items() for k, row in enumerate(m)})

    added = _added(different.select("x").mapInArrow(scatter, PARTS))
    found: dict[int, Whitening] = {}
    for d, n in count.items():
        values, vectors = jacobi(np.stack([added[d, k] for k in range(d)]) / n)
        some = values > max(values[0], 0) * d * np.finfo(float).eps
        some[components:] = False
        found[d] = Whitening(n, sums[d], vectors[:, some] / np.sqrt(values[some]), values[some] / values.sum())

    def check(batches: Iterator) -> Iterator:
        own: dict = {}
        for _, _, x in _matrices(batches, 0):
            d = x.shape[1]
            w = _centred(x, mean[d]) @ found[d].matrix
            w = np.c_[w, np.ones(len(w))]
            own[d] = own.get(d, 0) + w.T @ w
        yield _partial({(d, k): row for d, m in own.items() for k, row in enumerate(m)})

    import numpy as np

    added, error = _added(different.select("x").mapInArrow(check, PARTS)), 0.0
    for d, w in found.items():
        r = w.matrix.shape[1]
        if r:
            m = np.stack([added[d, k] for k in range(r + 1)]) / w.n
            # the means are zero but for rounding
            error = max(error, float(np.abs(m[:r, :r] - np.outer(m[r, :r], m[r, :r]) - np.eye(r)).max()))
    return found, error


def _mean(sums: list[int], n: int):
    """Whole and fractional part of the mean of each dimension: a difference to it keeps all its digits."""
    import numpy as np

    return np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])


def _centred(x, mean):
    return (x - mean[0]).astype(float) - mean[1]


def _deviations(x, n: int, sums: list[int]) -> list:
    """Of each row the sum of (n * x - sum)^2, in whole numbers; none where 64 bits don't hold it."""
    import numpy as np

    s = np.array(sums, object)
    if max(n * abs(int(x.max())), n * abs(int(x.min())), max(map(abs, sums))) < 1 << 62:
        away = x * n - np.array(sums, np.int64)
        if int(max(abs(int(away.max())), abs(int(away.min())))) ** 2 * x.shape[1] < 1 << 63:
            return (away * away).sum(1).tolist()
    out = [sum(v * v for v in row) for row in (x.astype(object) * n - s).tolist()]
    return [v if v < 1 << 63 else None for v in out]


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of each usable vector."""
    fit = usable(F.col("embedding")) & F.forall("embedding", lambda c: F.abs(c.cast("double") * SCALE) < TOO_LARGE)
    return vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT)).alias("x"))


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each usable row and component.

    The fit list has each different vector once. Whitened vectors have, over that list, mean zero and the identity as
    covariance. Components fall in variance; those without any have no rows, so a table of one vector, or an empty
    one, gives none.

    Vectors that are null, empty, or hold null or non-finite entries, or some of 2^46 or more in size (whole numbers no
    longer exact), are dropped. Each length of vectors has a fit of its own. Null ids and repeated rows get
    rows like others. deviation is null where 64 bits don't hold it. Columns besides vec_id and embedding play no part.
    """
    rows = scaled(vectors)
    different = stage(rows.select("x").distinct(), "whitening-fit")
    found, error = fit(different, components)
    drop(different)
    known = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part, at, x in _matrices(batches, 1):
            w = known.value[x.shape[1]]
            r = w.matrix.shape[1]
            if not r:
                continue
            white = _centred(x, _mean(w.sums, w.n)) @ w.matrix
            ids, m = part.column(0).take(pa.array(at)), len(at)
            each = pa.array(np.repeat(np.arange(m), r))
            columns = [ids.take(each), np.tile(np.arange(1, r + 1, dtype=np.int32), m), np.full(m * r, w.n), pa.array(_deviations(x, w.n, w.sums), pa.int64()).take(each), white.reshape(-1), np.tile(w.explained, m), np.full(m * r, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


__all__ = ["Whitening", "fit", "jacobi", "scaled", "whiten"]
