"""Whitening of embeddings from an exact covariance, found by polarisation.

Vectors become integers on a grid. The fit list holds each different integer vector once. For every dimension and for the
sum of every two dimensions the squares of the centred values are added up, exactly:
``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2``. Tasks add up squares of values centred at the integer next to the
mean, which are small whatever the size of the table; what is left of the mean is put right in whole numbers at the end.
The driver gets one number for each pair of dimensions, and eigh runs on that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.ann import common_dimension
from voxelry.llm.shared import written

SCALE = 256
COMPONENTS = 4
#: Values that are worked on at once in a task.
AT_ONCE = 1 << 20
_SAFE = 1 << 62
#: Totals travel in two halves, so that no sum outgrows 38 digits.
_HALF = 10**20
#: Eigenvalues below this share of the largest are zero up to rounding; such components have no whitened values.
FLAT = 1e-13


@dataclass
class Whitening:
    """``n`` fitted vectors with the sums ``sums``; eigenvalues (falling), the components as rows, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([round_half(s, self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """What is left of the mean, times n: sums - n * centre."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.centre)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers projected on the components, over the roots of the eigenvalues; NaN where a component is flat."""
        z = (x - self.centre).astype(np.float64) - np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return z @ self.components.T / np.sqrt(np.where(self.values > FLAT * max(self.values[0], 0.0), self.values, np.nan))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact ``sum((n * x - sums) ** 2)`` of each row."""
        n, z = self.n, x - self.centre
        rest = np.array(self.rest, dtype=object)
        most, left = int(np.abs(z).max(initial=0)), max((abs(r) for r in self.rest), default=0)
        if (n * most + left) ** 2 * max(1, x.shape[1]) < _SAFE:
            y = n * z - rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        if most * left * x.shape[1] < _SAFE:
            cross = (z * rest.astype(np.int64)).sum(axis=1)
        else:
            cross = (z.astype(object) * rest).sum(axis=1)
        return [n * n * int(s) - 2 * n * int(c) + int((rest * rest).sum()) for s, c in zip(_squares(z), cross)]


def round_half(a: int, n: int) -> int:
    """The integer next to a / n."""
    return (2 * a + n) // (2 * n)


def _squares(z: np.ndarray) -> np.ndarray:
    """Sums of squares along the rows, in Python's whole numbers where 64 bits may not do."""
    if int(np.abs(z).max(initial=0)) ** 2 * max(1, z.shape[1]) < _SAFE:
        return (z * z).sum(axis=1)
    z = z.astype(object)
    return (z * z).sum(axis=1)


def on_grid(vectors: DataFrame, column: str = "embedding", keys: list[str] | None = None) -> DataFrame:
    """``keys, x ARRAY<LONG>``: the rows whose vector is whole, each entry as ``floor(256 * c)``.

    Rows with null vectors, null or non-finite entries, without entries, or of another dimension than most rows are left out.
    Entries from 2^53 on do not fit the grid and count as non-finite.
    """
    v = F.transform(column, lambda e: e.cast("double"))
    whole = F.col(column).isNotNull() & (F.size(column) > 0) & (F.size(column) == common_dimension(vectors, column)) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= float(1 << 53)))
    return vectors.where(whole).select(*(keys or []), F.transform(v, lambda e: F.floor(e * float(SCALE)).cast("long")).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows:
            width = len(lists[0])
            step = max(1, AT_ONCE // max(1, width))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield part, np.asarray(lists.slice(at, step).flatten(), dtype=np.int64).reshape(part.num_rows, width)


def _sums_of(x: np.ndarray) -> list[int]:
    """Sums of columns; exact whatever their size."""
    if int(np.abs(x).max(initial=0)) * len(x) < _SAFE:
        return x.sum(axis=0).tolist()
    return [int(s) for s in x.astype(object).sum(axis=0)]


def _totals(fit: DataFrame, totals_of) -> dict[int, int]:
    """Adds up, over all rows, the whole numbers that ``totals_of(x)`` gives by place for a block of rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for _, x in _matrices(batches):
            found = totals_of(x)
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            halves = [pa.array([Decimal(h) for h in half], pa.decimal128(38, 0)) for half in zip(*(divmod(t, _HALF) for t in total))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *halves], names=["place", "high", "low"])

    rows = fit.select("x").mapInArrow(partial, "place int, high decimal(38,0), low decimal(38,0)").groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {r["place"]: int(r["high"]) * _HALF + int(r["low"]) for r in rows.collect()}  # one row for each dimension or pair of dimensions


def pair_squares(x: np.ndarray, centre: np.ndarray) -> list[int]:
    """Sums of squares of the values centred at integers: for every i the square of i, then of the sums of i and each j > i."""
    z = x - centre
    wide = (2 * int(np.abs(z).max(initial=0))) ** 2 * len(z) >= _SAFE
    z = np.ascontiguousarray((z.astype(object) if wide else z).T)
    out: list[int] = []
    for i in range(len(z)):
        out.append(int((z[i] * z[i]).sum()))
        if i + 1 < len(z):
            both = z[i + 1 :] + z[i]
            out.extend(int(s) for s in (both * both).sum(axis=1))
    return out


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """The covariance from the exact variances of dimensions and of sums of two, each entry rounded once."""
    d = len(sums)
    rest = [s - n * round_half(s, n) for s in sums]
    exact: dict[tuple[int, int], int] = {}  # n * n * variance of i, or of i + j
    at = 0
    for i in range(d):
        for j in range(i, d):
            r = rest[i] if i == j else rest[i] + rest[j]
            exact[i, j] = n * squares[at] - r * r
            at += 1
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = exact[i, i] / (n * n)
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (exact[i, j] - exact[i, i] - exact[j, j]) / (2 * n * n)
    return v


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits on ``fit(x ARRAY<LONG>)``, every row of which counts once. None without rows."""
    n = fit.count()
    if not n:
        return None
    by_place = _totals(fit, _sums_of)
    sums = [by_place[i] for i in range(len(by_place))]
    centre = np.array([round_half(s, n) for s in sums], dtype=np.int64)
    by_pair = _totals(fit, lambda x: pair_squares(x, centre))
    v = covariance(n, sums, [by_pair[i] for i in range(len(by_pair))])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components].copy(), vectors.T[::-1][:components].copy()
    for k, row in enumerate(vectors):  # one sign for all rows: the largest entry is positive
        vectors[k] = row if row[np.abs(row).argmax()] > 0 else -row
    return Whitening(n, sums, values, vectors, float(np.trace(v)))


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest entry, by size, of the covariance of the whitened fit list less the identity; flat components left out."""
    live = [k for k in range(len(model.values)) if model.values[k] > FLAT * max(model.values[0], 0.0)]
    if not live:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live)))
        for _, x in _matrices(batches):
            w = model.whitened(x)[:, live]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "total"])

    rows = fit.select("x").mapInArrow(partial, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    found = np.zeros(len(live) ** 2)
    for r in rows:
        found[r["place"]] = r["total"] / model.n
    return float(np.abs(found.reshape(len(live), len(live)) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Whitened values of every row of ``vectors(key, column)`` on the first ``components`` principal components.

    Returns a row for each row and component: ``key, component`` (from 1, by falling eigenvalue), ``n`` (different vectors),
    ``deviation DECIMAL(38,0)`` (exact), ``whitened``, ``explained`` and ``identity_error``, one value for all rows. Rows
    left out are those of ``on_grid``. Equal vectors count once in the fit and each has its rows; repeated rows and null
    keys stay. With fewer dimensions than ``components`` there are as many components as dimensions. A component along
    which the vectors do not vary (one vector only, say) has null whitened values; explained is null if nothing varies, and
    identity_error if no component does. A deviation beyond 38 digits is null. Of equal eigenvalues any basis may be
    returned. Other columns are ignored. No rows give no rows.
    """
    rows = written(on_grid(vectors, column, [key]), "grid")
    fit = written(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit, components)
    kind = vectors.schema[key].dataType.simpleString()
    columns = f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], columns)
    error, k = identity_error(fit, model), len(model.values)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches):
            w = model.whitened(x).ravel()
            each = np.repeat(np.arange(batch.num_rows), k)
            deviation = pa.array([Decimal(t) if t < 10**38 else None for t in model.deviation(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(each), model.n, dtype=np.int64)),
                    deviation.take(pa.array(each)), pa.array(w, mask=np.isnan(w)), pa.array(explained * batch.num_rows, pa.float64()), pa.array([error] * len(each), pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, "x").mapInArrow(run, columns)
