"""Whitening of integer vectors by an incremental eigendecomposition.

Every partition keeps the spectrum of the scatter of what it has read. New vectors are centred rank-one
updates: the eigenvalues are the roots of a secular equation, entries that the update does not
move are deflated, and eigenvectors follow from the roots. The partitions' spectra are
combined, a bounded number at a time, by the same updates. A last distributed pass projects the
covariance on the basis found and solves that small problem (Rayleigh-Ritz), which brings the
components to double precision. No covariance of the vectors is ever decomposed directly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.storage import park, slices, tasks_import

EPS = np.finfo(float).eps
FAN = 16  # spectra that one task combines


def quantized(vector: str, scale: int = 256) -> Column:
    """floor(scale * c) of every entry, c as double; null if the vector or any entry is null or not finite.
    A product beyond a long becomes the nearest long."""
    limit = float("inf")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == limit))
    return F.when(
        F.col(vector).isNotNull() & ~bad,
        F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")),
    )


# one spectrum


def _secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z2 / (d - x)), one above each of the increasing ``d``: the pole that each is
    measured from, and its distance from there. Rational interpolation, held in a bracket."""
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())  # behind the last root, as a pole without weight
    half = (upper - d) / 2
    middle = 1 + (z2 / (d - (d + half)[:, None])).sum(1)
    left = middle >= 0
    left[-1] = True
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d - d[origin][:, None]
    ends = (d - d[origin], upper - d[origin])
    low = np.where(left, 0.0, -half)
    high = np.where(left, np.where(middle >= 0, half, upper - d), 0.0)
    high = np.maximum(high, low)
    x = (low + high) / 2
    lower_side = np.tri(k, dtype=bool)
    open_roots = np.arange(k)
    for _ in range(60):
        gap = delta[open_roots] - x[open_roots, None]
        gap[gap == 0] = np.finfo(float).tiny
        terms = z2 / gap
        slopes = terms / gap
        below = lower_side[open_roots]
        psi, slope_psi = np.where(below, terms, 0).sum(1), np.where(below, slopes, 0).sum(1)
        phi, slope_phi = terms.sum(1) - psi, slopes.sum(1) - slope_psi
        f = 1 + psi + phi
        at = x[open_roots]
        low[open_roots] = np.where(f < 0, at, low[open_roots])
        high[open_roots] = np.where(f >= 0, at, high[open_roots])
        going = np.abs(f) > 4 * EPS * (1 + np.abs(psi) + np.abs(phi))
        going &= high[open_roots] - low[open_roots] > EPS * np.maximum(np.abs(low[open_roots]), np.abs(high[open_roots]))
        if not going.any():
            break
        one, two = ends[0][open_roots] - at, ends[1][open_roots] - at
        a = (one + two) * f - one * two * (slope_psi + slope_phi)
        b = one * two * f
        c = f - one * slope_psi - two * slope_phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = at + step
        inside = np.isfinite(new) & (new > low[open_roots]) & (new < high[open_roots])
        new = np.where(inside, new, (low[open_roots] + high[open_roots]) / 2)
        x[open_roots] = np.where(going, new, at)
        open_roots = open_roots[going]
    x[x == 0] = np.finfo(float).tiny
    return origin, x


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``basis diag(values) basis' + v v'``; values increase, the basis is orthogonal."""
    z = basis.T @ v
    size = max(abs(values[-1]), float(z @ z))
    if not size:
        return values, basis
    tolerance = 8 * EPS * size
    values, basis = values.copy(), basis.copy()
    moved = np.flatnonzero(np.abs(z) * math.sqrt(size) > tolerance)
    # of two nearly equal values one is turned out of the update's reach
    z1, z2 = z[moved[:-1]], z[moved[1:]]
    if len(moved) > 1 and (np.diff(values[moved]) * np.abs(z1 * z2) <= tolerance * (z1 * z1 + z2 * z2)).any():
        held, before = [], moved[0]
        for i in moved[1:]:
            length = math.hypot(z[before], z[i])
            c, s = z[i] / length, z[before] / length
            if (values[i] - values[before]) * abs(c * s) <= tolerance:
                first, second = basis[:, before].copy(), basis[:, i].copy()
                basis[:, before], basis[:, i] = c * first - s * second, s * first + c * second
                values[before], values[i] = (
                    c * c * values[before] + s * s * values[i],
                    s * s * values[before] + c * c * values[i],
                )
                z[before], z[i] = 0.0, length
            else:
                held.append(before)
            before = i
        moved = np.asarray([*held, before])
    if not len(moved):
        return values, basis
    moved = moved[np.argsort(values[moved], kind="stable")]
    d, z = values[moved], z[moved]
    origin, x = _secular(d, z * z)
    gaps = (d - d[origin][:, None]) - x[:, None]  # pole less root, a row per root
    # weights for which these roots are exact; eigenvectors made of them are orthogonal
    apart = d - d[:, None]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(gaps / apart, axis=0)))
    turned = np.copysign(exact, z) / gaps
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    basis[:, moved] = basis[:, moved] @ turned.T
    values[moved] = d[origin] + x
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """How many vectors, their exact sums, and the spectrum of their scatter about the mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, [0] * dim, np.zeros(dim), np.eye(dim))

    def _shift(self, n: int, sums: list[int]) -> None:
        """The update for the distance between the two means; sums and count follow."""
        if self.n and n:
            apart = np.asarray([a / self.n - b / n for a, b in zip(self.sums, sums)])
            self._update(apart * math.sqrt(self.n * n / (self.n + n)))
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums)]

    def _update(self, v: np.ndarray) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, v)

    def add(self, rows: np.ndarray) -> None:
        """A block of integer vectors. Rows of a block are first rotated among themselves into at most
        as many as there are dimensions, which leaves their scatter as it is; a block of one is a
        plain centred update."""
        sums = _exact_sums(rows)
        if len(rows) > 1:
            centred = rows.astype(float) - np.asarray([s / len(rows) for s in sums])
            for v in np.linalg.qr(centred, mode="r"):
                self._update(v)
        self._shift(len(rows), sums)

    def merge(self, other: Spectrum) -> None:
        """Another part's spectrum, one eigenvector after another."""
        for value, v in zip(other.values, other.basis.T):
            if value > 0:
                self._update(math.sqrt(value) * v)
        self._shift(other.n, other.sums)

    def row(self, slot: int) -> dict:
        return {
            "slot": slot, "n": self.n, "sums": [str(s) for s in self.sums],
            "values": self.values.tolist(), "basis": self.basis.ravel().tolist(),
        }

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        values = np.asarray(row["values"])
        return cls(row["n"], [int(s) for s in row["sums"]], values, np.asarray(row["basis"]).reshape(len(values), -1))


SPECTRUM = "slot long, n long, sums array<string>, values array<double>, basis array<double>"
_SPECTRUM = pa.schema([
    ("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())),
    ("values", pa.list_(pa.float64())), ("basis", pa.list_(pa.float64())),
])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact_sums(rows: np.ndarray) -> list[int]:
    if not len(rows):
        return [0] * rows.shape[1]
    largest = max(abs(int(rows.max())), abs(int(rows.min())))
    return [int(s) for s in (rows if largest * len(rows) < 1 << 62 else rows.astype(object)).sum(0)]


def _spectra(batches, dim: int, block: int):
    found = Spectrum.empty(dim)
    for batch in slices(batches, block):
        found.add(_matrix(batch.column(0), dim))
    if found.n:
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pylist([found.row(TaskContext.get().partitionId())], _SPECTRUM)


def _combine(table):
    rows = sorted(table.to_pylist(), key=lambda r: r["slot"])
    found = Spectrum.of(rows[0])
    for row in rows[1:]:
        found.merge(Spectrum.of(row))
    return pa.Table.from_pylist([found.row(rows[0]["slot"] // FAN)], _SPECTRUM)


def _spectrum(fit_list: DataFrame, dim: int, block: int) -> Spectrum:
    """The spectrum of the whole list: partitions' first, then up a tree of ``FAN`` branches."""
    level = park(fit_list.mapInArrow(partial(_spectra, dim=dim, block=block), SPECTRUM), "spectra")
    last = level.agg(F.max("slot")).first()[0]
    while last:
        level = park(level.groupBy(F.floor(F.col("slot") / FAN)).applyInArrow(_combine, SPECTRUM), "spectra")
        last //= FAN
    return Spectrum.of(level.first().asDict())


# passes over the fit list and the rows


def _centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where these hold it."""
    largest = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
    if n * largest + max(map(abs, sums)) < 1 << 62:
        return n * rows - np.asarray(sums, dtype=np.int64)
    return n * rows.astype(object) - np.asarray(sums, dtype=object)


def _places(matrix: np.ndarray) -> pa.RecordBatch:
    flat = matrix.ravel()
    return pa.record_batch([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["place", "value"])


def _projected(batches, n, sums, basis, scale):
    """Sums of products of the centred vectors' projections, and of the projections (last row)."""
    basis, scale = basis.value, np.asarray(scale)
    total = np.zeros((basis.shape[1] + 1, basis.shape[1]))
    for batch in slices(batches, 4096):
        y = (_centred(_matrix(batch.column(0), len(basis)), n, sums) / n).astype(float) @ basis / scale
        total[:-1] += y.T @ y
        total[-1] += y.sum(0)
    yield _places(total)


def _covariance(fit_list: DataFrame, n: int, sums: list[int], basis: np.ndarray, scale: np.ndarray) -> np.ndarray:
    k = basis.shape[1]
    held = fit_list.sparkSession.sparkContext.broadcast(basis)
    parts = fit_list.mapInArrow(partial(_projected, n=n, sums=sums, basis=held, scale=scale.tolist()), "place int, value double")
    summed = parts.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(k * (k + 1))
    total[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    total = total.reshape(k + 1, k) / n
    return total[:-1] - np.outer(total[-1], total[-1])


@dataclass(frozen=True)
class Whitening:
    """Everything a row needs: its size is set by the dimension alone."""

    n: int
    sums: list[int]
    components: np.ndarray  # columns, by falling eigenvalue
    values: np.ndarray
    trace: float
    identity_error: float | None


def fit(fit_list: DataFrame, dim: int, components: int = 4, block: int = 512) -> Whitening:
    """Learn from every row of ``fit_list`` (one column of array<long>, all of ``dim`` entries).

    ``block``: how many vectors a partition takes together, see ``Spectrum.add``. A component
    whose eigenvalue is zero within rounding has no whitened values and does not enter the identity error.
    """
    found = _spectrum(fit_list, dim, block)
    scatter = _covariance(fit_list, found.n, found.sums, found.basis, np.ones(dim))
    values, turn = np.linalg.eigh((scatter + scatter.T) / 2)
    values, basis = values[::-1], found.basis @ turn[:, ::-1]
    trace = float(np.trace(scatter))
    k = min(components, dim)
    values, basis = np.where(values > dim * EPS * max(values[0], 0), values, 0.0)[:k], basis[:, :k]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(k)])
    sound = values > 0
    error = None
    if sound.any():
        white = _covariance(fit_list, found.n, found.sums, basis[:, sound], np.sqrt(values[sound]))
        error = float(np.abs(white - np.eye(len(white))).max())
    return Whitening(found.n, found.sums, basis, values, trace, error)


def _whiten(batches, model, schema):
    model = model.value
    dim, k = model.components.shape
    sound = model.values > 0
    for batch in slices(batches, 4096):
        y = _centred(_matrix(batch.column(1), dim), model.n, model.sums)
        largest = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        squares = (y if dim * largest**2 < 1 << 63 else y.astype(object)) ** 2
        deviation = [s if s < 1 << 63 else None for s in map(int, squares.sum(1))]
        projected = (y / model.n).astype(float) @ model.components / np.sqrt(np.where(sound, model.values, 1.0))
        rows = batch.num_rows
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        columns = [
            batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
            pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
            pa.array(np.full(rows * k, model.n), pa.int64()),
            pa.array(np.repeat(np.asarray(deviation, dtype=object), k), pa.int64()),
            pa.array(projected.ravel(), pa.float64(), mask=~np.tile(sound, rows)),
            pa.array(np.tile(explained, rows), pa.float64(), mask=np.full(rows * k, not model.trace > 0)),
            pa.array([model.identity_error] * (rows * k), pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def whiten(rows: DataFrame, components: int = 4, block: int = 512) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error of
    each row of ``rows`` (vec_id, vector as array<long>) and each of the first ``components``.

    The fit list is each distinct vector once; ``n`` is its length and S its sums. ``deviation`` is the sum
    over dimensions of (n * x - S) ** 2, null beyond a long. ``whitened`` is the centred vector on the unit
    component over the root of its eigenvalue, null where that is zero (one distinct vector only,
    or fewer independent ones than components); ``explained`` is null if all are. Rows with a null
    vector take no part, those with a null vec_id do; repeated rows stay repeated. Vectors of
    another length are a fit of their own. Empty vectors have no components, an empty
    table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    tasks_import(spark)
    rows = rows.filter("vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    fit_list = park(rows.select("vector").distinct(), "fit-list")
    dims = [r[0] for r in fit_list.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect() if r[0]]
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = spark.createDataFrame([], result)
    for dim in dims:
        own = F.size("vector") == dim
        model = spark.sparkContext.broadcast(fit(fit_list.filter(own), dim, components, block))
        white = rows.filter(own).mapInArrow(partial(_whiten, model=model, schema=to_arrow_schema(found.schema)), result)
        found = found.unionAll(white) if len(dims) > 1 else white
    return found
