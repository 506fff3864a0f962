"""Whitening of embeddings: projection on scaled principal components.

Entries become integers ``floor(scale * c) + offset``. The fit list is each distinct
vector once, written to the shared folder. Its sums are exact; the covariance is summed
by tasks over centred entries, as rows of (cell, value) that Spark adds up, so the
driver gets one matrix of dimension by dimension, whatever the number of rows. There
the matrix is brought to tridiagonal form by Householder reflections, the leading
eigenvalues are bisected by Sturm counts, and inverse iteration finds their vectors,
which are made orthogonal again within clusters of close eigenvalues. Model and means
then go to all rows with the tasks.

Everything that is sent to the driver or with tasks is bounded by the dimension
(``MOST`` entries at most): one row a task and cell is added up in Spark before.

Nulls: rows with a null vector, or one holding null or non-finite entries, take no part;
nor do empty vectors, vectors of another length than most have (ties: the longer), and
entries beyond 2**46. Rows without an id are kept, with their null id. Ties: equal
eigenvalues have some orthonormal basis of their space, the same for all rows. Repeated
rows are fitted once and projected each. Components without variance (less than 1e-12
of the whole) are left out: there are none for a single distinct vector. A deviation
beyond 64 bits is null. Other columns take no part. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.llm.top_k import column_matrix
from thoughtloom.session import materialise

SCALE, OFFSET, COMPONENTS, MOST = 64, 1_000_000, 16, 4096
_LARGEST = float(1 << 46)
#: Share of the variance below which a component counts as none.
_LEAST = 1e-12


# -- leading eigenvectors of a symmetric matrix --------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reduction: diagonal, off-diagonal and the reflections' unit vectors."""
    a = np.array(a, float)
    d = len(a)
    reflections = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        v = x.copy()
        v[0] += length if x[0] >= 0 else -length
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v /= norm
        reflections[k, k + 1 :] = v
        # Both sides at once: A - 2 v w' - 2 w v' with w = A v - (v' A v) v.
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are smaller than each x (Sturm count)."""
    tiny = np.finfo(float).tiny * 4
    found = np.zeros(len(x), np.int64)
    q = np.ones(len(x))
    for i, value in enumerate(diagonal):
        q = value - x - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        found += q < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until no number lies between its bounds."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = np.full(count, (diagonal - reach).min()), np.full(count, (diagonal + reach).max())
    low, high = low - np.abs(low) * 1e-15 - 1e-300, high + np.abs(high) * 1e-15 + 1e-300
    rank = d - 1 - np.arange(count)  # so many are smaller
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        over = below(diagonal, off, middle) <= rank
        low, high = np.where(over, middle, low), np.where(over, high, middle)


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) x = b by elimination with row exchanges; zero pivots are made small."""
    d = len(diagonal)
    small = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), 1e-300)
    x = b.tolist()
    rows, row = [], (diagonal[0] - shift, off[0] if d > 1 else 0.0, 0.0)  # entries from the diagonal on
    for i in range(d - 1):
        under = (off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0)
        if abs(under[0]) > abs(row[0]):
            row, under = under, row
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(row[0]) <= small:
            row = (small, *row[1:])
        factor = under[0] / row[0]
        rows.append(row)
        row = (under[1] - factor * row[1], under[2] - factor * row[2], 0.0)
        x[i + 1] -= factor * x[i]
    rows.append(row if abs(row[0]) > small else (small, 0.0, 0.0))
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            x[i] -= rows[i][1] * x[i + 1]
        if i + 2 < d:
            x[i] -= rows[i][2] * x[i + 2]
        x[i] /= rows[i][0]
    return np.array(x)


def leading_vectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    diagonal, off, reflections = tridiagonal(matrix)
    d = len(diagonal)
    count = min(count, d)
    values = leading_values(diagonal, off, count)
    near = 1e-3 * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    random, vectors = np.random.default_rng(d), np.zeros((d, count))
    first = 0  # of the cluster: a run of values with small gaps
    for j in range(count):
        first = j if j and values[j - 1] - values[j] > near else first
        x = random.standard_normal(d)
        for _ in range(4):
            x = solved(diagonal, off, values[j], x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[:, first:j] @ (vectors[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    for v in reflections[::-1]:
        vectors -= 2 * np.outer(v, v @ vectors)
    return values, vectors / np.linalg.norm(vectors, axis=0)


# -- sums over the fit list -----------------------------------------------------------


def quantised(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x): integer vectors of the rows that take part, all of one length."""
    vector = F.col(vector_column)
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST)) & (F.size(vector) > 0)
    x = F.transform(vector, lambda c: (F.floor(F.lit(float(SCALE)) * c.cast("double")) + OFFSET).cast("long"))
    kept = rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).alias("vec_id"), x.alias("x"))
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    if d > MOST:
        raise ValueError(f"vectors have {d} entries; the covariance is held for {MOST} at most")
    return kept.where(F.size("x") == d)


@dataclass
class Model:
    """Means and components, bounded by the dimension."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts apart, so that large means cost no digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S) ** 2; null beyond 64 bits."""
        whole = [s // self.n for s in self.sums]
        steps, rest = x - np.array(whole, np.int64), [s % self.n for s in self.sums]
        most = self.n * (int(np.abs(steps).max(initial=0)) + 1)
        if most * most * len(rest) < 1 << 63:
            return ((self.n * steps - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in steps.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def _counted(batches):
    """Per task: number of vectors (place -1) and sums of each place."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = column_matrix(batch.column(0), len(batch.column(0)[0]))
            n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, len(total)), pa.int32()), "total": pa.array([n, *total.tolist()], pa.int64())})


def _products(width: int, of):
    """Per task: sums of the products of ``of(x)``'s columns, and of its columns, by cell."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = of(column_matrix(batch.column(0).slice(at, 4096), width))
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i * len(total) + j), pa.array(total[i, j])], ["cell", "value"])

    return run


def _matrix(fit: DataFrame, width: int, of) -> np.ndarray:
    """Covariance (divisor n) of ``of(x)`` over the fit list, added up by Spark."""
    cells = fit.mapInArrow(_products(width, of), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    size = max(r.cell for r in cells) + 1
    size = round(size**0.5)
    total = np.zeros((size, size))
    for r in cells:
        total[r.cell // size, r.cell % size] = total[r.cell % size, r.cell // size] = r.value
    n, means = total[-1, -1], total[-1, :-1] / total[-1, -1]
    return total[:-1, :-1] / n - np.outer(means, means)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Model | None, float]:
    """Model of (x) rows, and the largest error of the whitened covariance; None without variance."""
    distinct = materialise(rows.select("x").distinct())
    told = distinct.mapInArrow(_counted, "place int, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {r.place: int(r.total) for r in told.collect()}
    if not totals:
        return None, 0.0
    n, d = totals.pop(-1), len(totals)
    model = Model(n, [totals[i] for i in range(d)], np.ones(1), np.zeros((d, 1)), 0.0)
    covariance = _matrix(distinct, d, model.centred)
    model.trace = float(np.trace(covariance))
    values, vectors = leading_vectors(covariance, components)
    kept = values > _LEAST * max(model.trace, 1e-300)
    if not kept.any():
        return None, 0.0
    model.values, model.components = values[kept], vectors[:, kept]
    error = np.abs(_matrix(distinct, d, model.whitened) - np.eye(int(kept.sum()))).max()
    return model, float(error)


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def project(rows: DataFrame, model: Model | None, error: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        k, names = len(model.values), ["vec_id", *[x.split()[0] for x in RESULT.split(", ")]]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = column_matrix(part.column(1), len(model.sums))
                repeated = np.repeat(np.arange(len(x)), k)
                columns = [
                    part.column(0).take(pa.array(repeated)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(repeated)),
                    pa.array(model.whitened(x).reshape(-1)),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return (rows if model else rows.limit(0)).mapInArrow(run, f"vec_id {id_type}, {RESULT}")


def whiten(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The whitened components of every row that takes part."""
    prepared = quantised(rows, id_column, vector_column)
    return project(prepared, *fit(prepared, components))
