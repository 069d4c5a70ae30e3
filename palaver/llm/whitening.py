"""Whitening of vectors: exact integer moments in Spark, components by spectral divide and conquer of their covariance.

Only sums of a fixed size (per-dimension sums and a matrix of dimensions x dimensions) leave the tasks; they are added up
by Spark before the driver takes the one matrix. The components go back to the tasks in a closure of at most
``components`` x dimensions numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palaver.session import ship

#: Fixed values of the integer form: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Integers beyond this are cut to it, so that sums stay exact.
_FAR = 2.0 ** 40
_ROWS = 4096
_SALTS = 64
_EPS = np.finfo(float).eps


def integers(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, x) of the vectors of ``dim`` entries that hold no null and no non-finite entry."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    if dim is None:
        return np.flatnonzero(sizes >= 0), sizes
    chosen = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(chosen)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), float).reshape(len(chosen), dim)
    whole = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(values[whole] * SCALE), -_FAR, _FAR).astype(np.int64) + OFFSET
    return chosen[whole], x


def _per_task(df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """One small table from every task."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for made in work(batches):
            yield pa.RecordBatch.from_pydict(made, schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _add_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows (salt, i, row) of all tasks added up by i: inside salts first, so no group grows with the number of tasks as a whole."""
    def add(table: pa.Table) -> pa.Table:
        rows = np.asarray(table["row"].combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        return pa.table({"salt": pa.array([0], pa.int32()), "i": table["i"].slice(0, 1).cast(pa.int32()),
                         "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "salt int, i int, row array<double>"
    salted = parts.groupBy("i", "salt").applyInArrow(add, schema)
    return {r["i"]: np.array(r["row"]) for r in salted.groupBy("i").applyInArrow(add, schema).collect()}


def _gram(df: DataFrame, column: str, rows_of: Callable[[pa.Array], np.ndarray], width: int) -> np.ndarray:
    """The sum of row^T row over all rows that ``rows_of`` gives for a column of vectors."""
    def work(batches):
        total, seen = np.zeros((width, width)), 0
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = rows_of(batch.column(column).slice(start, _ROWS))
                total += part.T @ part
                seen += len(part)
        if seen:
            from pyspark import TaskContext
            salt = TaskContext.get().partitionId() % _SALTS
            yield {"salt": [salt] * width, "i": list(range(width)), "row": list(total)}

    made = _add_up(_per_task(df.select(column), "salt int, i int, row array<double>", work))
    return np.stack([made.get(i, np.zeros(width)) for i in range(width)]) if width else np.zeros((0, 0))


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    norm = np.abs(a).sum(axis=0).max()
    x, low = a / norm, _EPS
    for _ in range(30):
        last, square = x, low * low
        d = np.cbrt(4 * (1 - square) / square ** 2) if low < 1 else 0.0
        w = np.sqrt(1 + d)
        weight = w + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * w))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:  # by QR while the matrix may be badly conditioned, by a solve afterwards
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))[0]
            x = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            x = b / c * x + (weight - b / c) * np.linalg.solve(np.eye(n) + c * (x @ x), x)
        x = (x + x.T) / 2
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if abs(1 - low) < 8 * _EPS and np.linalg.norm(x - last) < np.cbrt(5 * _EPS):
            break
    return x


def _invariant(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first k columns span the eigenvectors above a shift; None if a is a multiple of one."""
    n = len(a)
    diag = np.diag(a)
    middle, spread = diag.mean(), np.linalg.norm(a - diag.mean() * np.eye(n)) / np.sqrt(n)
    shifts = [float(np.median(diag)), middle, *(middle + spread * t for t in rng.uniform(-0.8, 0.8, 30))]
    for shift in shifts:
        moved = a - shift * np.eye(n)
        if not np.abs(moved).max():
            continue
        u = polar(moved)
        k = int(round((np.trace(u) + n) / 2))
        if 0 < k < n and np.linalg.norm(u @ u - np.eye(n)) < 1e-10 * n:
            projector = (u + np.eye(n)) / 2
            q = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
            return np.linalg.qr(projector @ q, mode="complete")[0], k
    return None


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    Polar factors of the shifted matrix give projectors on the eigenvectors above and below the shift; both parts are
    divided further until they have one dimension, or are multiples of the identity to double precision.
    Of either sign the one that makes the greatest entry positive is taken.
    """
    n = len(v)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    rng, scale, found = np.random.default_rng(12), np.linalg.norm(v), []
    parts = [((v + v.T) / 2, np.eye(n))]
    while parts:
        a, basis = parts.pop()
        rest = np.linalg.norm(a - np.diag(np.diag(a)))
        split = _invariant(a, rng) if len(a) > 1 and rest > _EPS * scale * 0.01 else None
        if split is None:
            found += [(a[i, i], basis[:, i]) for i in range(len(a))]
            continue
        q, k = split
        for side in (q[:, :k], q[:, k:]):
            small = side.T @ a @ side
            parts.append(((small + small.T) / 2, basis @ side))
    vectors = np.stack([x for _, x in found], axis=1)
    vectors = np.linalg.qr(vectors)[0] * 1.0  # rounding errors of the products of bases
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values[order], vectors * np.where(sign == 0, 1, sign)


@dataclass(frozen=True)
class Whitening:
    """What a task needs: row count, sums, projection (dimensions x components), shares of the variance, which can be whitened."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance above the rounding errors of the covariance."""
        return self.values > max(self.trace, 0.0) * self.dim * _EPS

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1.0)), np.inf)
        return self.centred(x) @ (self.vectors / scale)


def fit_whitening(embeddings: DataFrame, column: str = "embedding", components: int = 32) -> Whitening | None:
    """Moments and components of all whole vectors of the most frequent length (of equally frequent ones the greatest).

    None without any. Three passes: counts and sums, the centred covariance, and the covariance of what is whitened.
    """
    df = embeddings.select(F.col(column).cast("array<double>").alias("vector"))

    def lengths(batches):
        for batch in batches:
            sums: dict[int, list] = {}
            _, sizes = integers(batch.column("vector"))
            for dim in np.unique(sizes[sizes > 0]).tolist():
                _, x = integers(batch.column("vector"), dim)
                if len(x):
                    sums[dim] = [len(x), x.sum(axis=0)]
            yield {"dim": list(sums), "n": [s[0] for s in sums.values()], "sums": [s[1] for s in sums.values()]}

    found = _per_task(df, "dim int, n bigint, sums array<bigint>", lengths)
    first = found.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return None
    dim, n = int(first["dim"]), int(first["n"])
    each = found.where(F.col("dim") == dim).select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
    sums = np.zeros(dim, np.int64)
    for row in each.collect():  # one number a dimension
        sums[row["pos"]] = row["s"]
    moments = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    cov = _gram(df, "vector", lambda c: moments.centred(integers(c, dim)[1]), dim) / n
    values, vectors = spectrum(cov)
    made = Whitening(n, sums, values[:components], vectors[:, :components], float(np.trace(cov)))
    width = len(made.values)
    white = _gram(df, "vector", lambda c: made.whitened(integers(c, dim)[1]), width) / n
    off = np.abs(white - np.eye(width))[np.ix_(made.usable, made.usable)]
    return Whitening(n, sums, made.values, made.vectors, made.trace, float(off.max()) if off.size else None)


def whiten(embeddings: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per whole vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold null or non-finite entries or have another length than the model give no rows, nor does
    a table without whole vectors. Repeated rows all count and all come out. ``whitened`` is null for a component without
    variance (repeated vectors, fewer vectors than dimensions), ``explained`` is null if no component has any, and
    ``deviation`` is null where it does not fit a long. Other columns are left aside.
    """
    kind = embeddings.schema[key].dataType
    fields = T.StructType([
        T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if model is None:
        return embeddings.sparkSession.createDataFrame([], fields)
    arrow, width = to_arrow_schema(fields), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(width, np.nan)

    def tiled(values: np.ndarray, times: int, null: np.ndarray | None = None) -> pa.Array:
        return pa.array(np.tile(values, times), mask=None if null is None else np.tile(null, times))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                at, x = integers(batch.column("vector"), model.dim)
                apart = model.n * x - model.sums
                fits = (apart.astype(float) ** 2).sum(axis=1) < 2.0 ** 62
                deviation = np.where(fits, (apart * apart).sum(axis=1), 0)
                rows = len(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column(key).take(pa.array(np.repeat(at, width))).cast(arrow.field(key).type),
                    tiled(np.arange(1, width + 1, dtype=np.int32), rows),
                    pa.array(np.full(rows * width, model.n, np.int64)),
                    pa.array(np.repeat(deviation, width), mask=np.repeat(~fits, width)),
                    pa.array(model.whitened(x).ravel(), mask=np.tile(~model.usable, rows)),
                    tiled(explained, rows, np.isnan(explained)),
                    pa.array([model.identity_error] * (rows * width), pa.float64()),
                ], schema=arrow)

    ship(embeddings.sparkSession)
    return embeddings.select(F.col(key), F.col(column).cast("array<double>").alias("vector")).mapInArrow(run, fields)
