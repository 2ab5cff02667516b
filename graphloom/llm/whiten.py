"""Embedding whitening by spectrum slicing.

Passes over the vectors give, by exact integer sums, their number and mean and then the covariance of the centred
entries; sums go up a tree of tasks, so none meets more than the square root of all partial sums.  The covariance is as
large as the square of the dimensions, whatever the rows.  Its spectrum is sliced on the driver: the signs of D in
LDL' of the shifted covariance count the eigenvalues below the shift (Sylvester's law of inertia), and counts shared by
all eigenvalues halve intervals until each holds one.  Inverse iteration at the interval's middle gives a vector from
which Rayleigh quotient iteration converges cubically; if the quotient leaves the interval, the interval is halved
further.  In the end counts on both sides of each quotient certify its number.  Eigenvalues that stay together down to
rounding are a cluster, whose vectors are kept orthogonal to each other.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; shorter ones (empty ones too) are
filled with zero entries to the longest; null ids and repeated rows each get their rows; equal eigenvalues may take any
basis of their space, one for all rows; entries whose whole number leaves 64 bits (less 2^62, where sums of two begin)
are the nearest such number; a deviation beyond 64 bits is the largest 64-bit number; a component without variance (a
single row, constant or fewer rows than components) has explained 0, whitened null and no part in identity_error,
which is 0 if all are such; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, table, tidy

SHIFT, SCALE = 1_000_000, 64.0
_LIMIT = 2.0**62
_EXACT = 2.0**53
_SUM = "n long, sums array<string>"


# --------------------------------------------------------------------------- entries


def entries(column: pa.Array, scale: float = SCALE, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors that take part: whole numbers floor(scale * c) as 64-bit integers, one row each, with
    zeros up to width or the longest of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(ok))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries: nan
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.ones(len(sizes), bool)
    good[row[~np.isfinite(values)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.clip(np.nan_to_num(np.floor(values * scale), nan=0.0, posinf=_LIMIT, neginf=-_LIMIT), -_LIMIT, _LIMIT).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes[good].max(initial=0)))), np.int64)
    mine = good[row]
    out[row[mine], (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[mine]] = values[mine]
    return ok[good], out[good]


def _whole(a: np.ndarray) -> np.ndarray:
    """Python integers of an integer or whole double array."""
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


def products(d: np.ndarray) -> np.ndarray:
    """Exact sums of the outer products of the rows, as Python integers."""
    most = float(np.abs(d).max(initial=0))
    if most * most * len(d) < _EXACT:
        x = d.astype(np.float64)
        return _whole(x.T @ x)
    x = _whole(d)
    return x.T @ x


# --------------------------------------------------------------------------- sums up a tree


def tree_sum(parts: DataFrame, schema: str, add: Callable[[list], list]) -> list | None:
    """One row of all rows of parts, put together by add (two rows to one), in two rounds of tasks; none for no rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = None, None
        for batch in batches:
            kind = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                total = list(row) if total is None else add(total, list(row))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(total, kind)], kind.names)

    middle = max(1, math.isqrt(_tasks(parts)))
    by = parts.withColumn("_by", F.pmod(F.spark_partition_id(), F.lit(middle)))
    some = by.repartition(middle, "_by").drop("_by").mapInArrow(tidy(fold), schema)
    found = some.repartition(1).mapInArrow(tidy(fold), schema).first()
    return list(found) if found else None


def _tasks(df: DataFrame) -> int:
    """About how many tasks read df."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return max(spark.sparkContext.defaultParallelism, min(size // each, 1 << 20))


def _add(a: list, b: list) -> list:
    """Numbers and sums; of unequal length where some vectors are shorter."""
    if len(a[1]) < len(b[1]):
        a, b = b, a
    return [a[0] + b[0], [str(int(x) + int(y)) for x, y in zip(a[1], b[1])] + a[1][len(b[1]) :]]


def _first(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = entries(batch.column(0), scale)
            if len(rows):
                high, low = rows >> 32, rows & 0xFFFFFFFF  # neither sum overflows
                sums = [str((int(h) << 32) + int(x)) for h, x in zip(high.sum(0), low.sum(0))]
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([sums], pa.list_(pa.string()))], ["n", "sums"])

    return run


def _second(scale: float, centre: np.ndarray):
    """Products of the entries less a whole number next to each mean: small numbers, exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            _, rows = entries(batch.column(0), scale, len(centre))
            if len(rows):
                own = products(rows - centre)
                total, n = own if total is None else total + own, n + len(rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(x) for x in total.ravel()]], pa.list_(pa.string()))], ["n", "sums"])

    return run


def covariance(products: list[int], n: int, rest: list[int]) -> np.ndarray:
    """Covariance, divisor n, from the sums of products of the entries less whole centres, and the sums rest of those
    entries (each less than n in size): exact up to the last rounding."""
    d = len(rest)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = float(Fraction(n * products[i * d + j] - rest[i] * rest[j], n * n))
    return out


# --------------------------------------------------------------------------- spectrum


def inertia(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric a below the shift: the negative ones of D in LDL' of a - shift * I, with
    pivots of one or two rows (Bunch and Kaufman's choice)."""
    a = a - shift * np.eye(len(a))
    alpha = (1 + math.sqrt(17)) / 8
    tiny = np.finfo(float).eps * max(float(np.abs(a).max(initial=0)), np.finfo(float).tiny)
    below, k, n = 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        step = 1
        if k < n - 1:
            column = np.abs(a[k + 1 :, k])
            r = k + 1 + int(column.argmax())
            most = column[r - k - 1]
            if abs(a[k, k]) < alpha * most:
                other = np.abs(a[k:, r])
                other[r - k] = 0.0
                second = other.max()
                if abs(a[k, k]) * second >= alpha * most * most:
                    pass
                elif abs(a[r, r]) >= alpha * second:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    step = 2
        if step == 1:
            pivot = a[k, k] if abs(a[k, k]) > tiny else tiny
            below += pivot < 0
            v = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(v, v / pivot)
        else:
            below += 1  # a pivot of two rows is chosen where it has one eigenvalue of each sign
            block, v = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[1, 0], block[0, 0]]]) / det
            a[k + 2 :, k + 2 :] -= v @ inverse @ v.T
        k += step
    return below


def slices(a: np.ndarray, wanted: int, width: float) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, eigenvalues below low, below high) around the wanted largest eigenvalues, the largest last,
    each with one of them or no wider than width."""
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    pad = max(abs(low), abs(high), np.finfo(float).tiny) * 1e-12
    todo, done = [(low - pad, high + pad, 0, len(a))], []
    while todo:
        low, high, under, upto = todo.pop()
        if upto <= max(under, len(a) - wanted):
            continue  # none of those asked for
        if upto - under == 1 or high - low <= width:
            done.append((low, high, under, upto))
            continue
        middle = (low + high) / 2
        k = min(max(inertia(a, middle), under), upto)
        todo += [(low, middle, under, k), (middle, high, k, upto)]
    return sorted(done)


def _solve(a: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    n = len(a)
    try:
        return np.linalg.solve(a - shift * np.eye(n), v)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(a - (shift + np.spacing(max(abs(shift), np.abs(a).max()))) * np.eye(n), v)


def _unit(v: np.ndarray, beside: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in beside:
            v = v - (u @ v) * u
        v = v / np.linalg.norm(v)
    return v


def eigenpair(a: np.ndarray, low: float, high: float, under: int, beside: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """The eigenvalue in (low, high), above under others, and its unit vector, orthogonal to those beside it."""
    rng = np.random.default_rng(seed)
    least = 4 * np.finfo(float).eps * max(float(np.abs(a).sum(1).max()), np.finfo(float).tiny)
    while True:
        v = _unit(rng.standard_normal(len(a)), beside)
        for _ in range(3):
            v = _unit(_solve(a, (low + high) / 2, v), beside)
        value = float(v @ a @ v)
        for _ in range(30):
            if not low - least <= value <= high + least:
                break  # the iteration went to a neighbour
            residual = np.linalg.norm(a @ v - value * v)
            if residual <= least:
                # one step more, from an accurate quotient
                v = _unit(_solve(a, value, v), beside)
                return float(v @ a @ v), v
            v = _unit(_solve(a, value, v), beside)
            value = float(v @ a @ v)
        if high - low <= least:
            return value, v
        middle = (low + high) / 2
        low, high = (low, middle) if inertia(a, middle) > under else (middle, high)


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as rows) of the wanted largest eigenvalues of the symmetric a, the largest first."""
    wanted = min(wanted, len(a))
    if not wanted or not np.abs(a).max():
        return np.zeros(wanted), np.eye(len(a))[:wanted]
    # in powers of two, so that scaling rounds nothing
    unit = 2.0 ** math.frexp(float(np.abs(a).max()))[1]
    a = a / unit
    noise = 16 * len(a) * np.finfo(float).eps
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for low, high, under, upto in reversed(slices(a, wanted, noise)):
        beside: list[np.ndarray] = []
        for k in range(upto - 1, under - 1, -1):
            # neighbours too close for their vectors to be orthogonal by themselves
            near = [v for e, v in zip(values, vectors) if e - high < 1e-4]
            value, vector = eigenpair(a, low, high, under, near + beside, k)
            beside.append(vector)
            values.append(value)
            vectors.append(vector)
            if len(values) == wanted:
                break
        if len(values) == wanted:
            break
    order = sorted(range(len(values)), key=lambda i: -values[i])
    values, vectors = [values[i] for i in order], [vectors[i] for i in order]
    for i, value in enumerate(values):
        certify(a, value, i, noise)
    e, v = np.array(values) * unit, np.array(vectors)
    return e, v * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None]


def certify(a: np.ndarray, value: float, place: int, noise: float) -> None:
    """Raises unless value is the eigenvalue with place larger ones, equal ones (to rounding) aside."""
    below, upto = inertia(a, value - noise), inertia(a, value + noise)
    if not len(a) - upto <= place < len(a) - below:
        raise ArithmeticError(f"eigenvalue {place + 1} has not that number: {below} lie below it, {upto} not above")


# --------------------------------------------------------------------------- rows


class Whitening:
    """What a fit gives; small, so tasks get it with their code."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, wanted: int, scale: float):
        self.n, self.scale = n, scale
        self.centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre)]
        self.values, self.vectors = components(v, wanted)
        trace = float(np.trace(v))
        noise = 64 * len(v) * np.finfo(float).eps * (self.values[0] if len(self.values) else 0.0)
        self.has = self.values > noise
        self.explained = np.where(self.has, self.values / trace if trace > 0 else 0.0, 0.0)
        self.mean = np.array([r / n for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.project = np.where(self.has[:, None], self.vectors / np.sqrt(np.abs(self.values))[:, None], np.nan)

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre).astype(np.float64) - self.mean) @ self.project.T

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """Sums of (n * x - S)^2, exact; clipped to 64 bits."""
        d, n = rows - self.centre, self.n
        most, rest = float(np.abs(d).max(initial=0)), max((abs(r) for r in self.rest), default=0)
        if d.shape[1] * (n * most + rest) ** 2 < _LIMIT:
            return ((n * d - np.array(self.rest, np.int64)) ** 2).sum(1)
        r = np.array(self.rest, object)
        if d.shape[1] * most * max(most, rest) < _LIMIT:  # few exact numbers a row, and long ones only in the end
            squares, products = (d * d).sum(1), (d * np.array(self.rest, np.int64)).sum(1)
        else:
            d = _whole(d)
            squares, products = (d * d).sum(1), (d * r).sum(1)
        whole = int((r * r).sum()) if len(r) else 0
        return np.array([min(n * n * int(a) - 2 * n * int(b) + whole, 2**63 - 1) for a, b in zip(squares, products)], np.int64)


def _moments(fit: Whitening):
    """Number, means and centred products of the whitened rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, rows = entries(batch.column(0), fit.scale, len(fit.centre))
            if len(rows):
                w = fit.whitened(rows)[:, fit.has]
                mean = w.mean(0)
                w = w - mean
                own = [len(rows), mean.tolist(), (w.T @ w).ravel().tolist()]
                total = own if total is None else _merge(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), *[pa.array([x], pa.list_(pa.float64())) for x in total[1:]]], ["n", "mean", "products"])

    return run


def _merge(a: list, b: list) -> list:
    """Moments of two sets of rows put together."""
    n = a[0] + b[0]
    x, y = np.array(a[1]), np.array(b[1])
    gap = y - x
    return [n, (x + gap * (b[0] / n)).tolist(), (np.array(a[2]) + np.array(b[2]) + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)).tolist()]


_ROW = "vec_id long,component int,n long,deviation long,whitened double,explained double,identity_error double"


def _rows(fit: Whitening, error: float, limit: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(fit.values)
        for batch in batches:
            for lo in range(0, batch.num_rows, limit):
                part = batch.slice(lo, limit)
                at, rows = entries(part.column(1), fit.scale, len(fit.centre))
                n = len(rows)
                if not n or not c:
                    continue
                w = fit.whitened(rows).ravel()
                yield table(
                    _ROW,
                    vec_id=part.column(0).take(pa.array(np.repeat(at, c))),
                    component=np.tile(np.arange(1, c + 1), n),
                    n=np.full(n * c, fit.n),
                    deviation=np.repeat(fit.deviations(rows), c),
                    whitened=pa.array(w, pa.float64(), mask=np.tile(~fit.has, n)),
                    explained=np.tile(fit.explained, n),
                    identity_error=np.full(n * c, error),
                )

    return run


def fit(vectors: DataFrame, wanted: int = 32, scale: float = SCALE, vector_col: str = "embedding") -> Whitening | None:
    """Mean and leading components of all vectors that take part; None without any."""
    own = need(vectors, **{vector_col: "array<double>"})
    found = tree_sum(own.mapInArrow(tidy(_first(scale)), _SUM), _SUM, _add)
    if found is None:
        return None
    n, sums = found[0], [int(x) for x in found[1]]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    found = tree_sum(own.mapInArrow(tidy(_second(scale, centre)), _SUM), _SUM, _add)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    return Whitening(n, sums, covariance([int(x) for x in found[1]], n, rest), wanted, scale)


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = int(model.has.sum())
    if not k:
        return 0.0
    schema = "n long, mean array<double>, products array<double>"
    n, _, products = tree_sum(need(vectors, **{vector_col: "array<double>"}).mapInArrow(tidy(_moments(model)), schema), schema, _merge)
    return float(np.abs(np.array(products).reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, wanted: int = 32, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each
    of the wanted leading components (all, if fewer).

    Entries are x = floor(scale * c) + SHIFT; neither covariance nor deviation changes with the shift, so sums leave it
    out.
    """
    own = need(vectors, **{id_col: "long", vector_col: "array<double>"})
    model = fit(vectors, wanted, scale, vector_col)
    schema = _ROW.replace(",", ", ")
    if model is None:
        return own.sparkSession.createDataFrame([], schema)
    return own.mapInArrow(tidy(_rows(model, identity_error(vectors, model, vector_col))), schema)
