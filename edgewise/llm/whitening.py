"""Whitening of embeddings by exact cross-products from bit planes.

Components become whole numbers on a grid. A task shifts each dimension of a
block of rows so that its least value is 0 and packs every bit plane across the
rows into 64-bit words; the population counts of the ANDs of two planes,
weighted by powers of two, are the block's cross-product sums, exactly. They
are moved back to the unshifted numbers, summed over all blocks by Spark, and
centred as whole numbers; only the covariance that results is floating point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Steps of the grid in 1, components returned, rows whose planes are packed together.
SCALE, COMPONENTS, BLOCK_ROWS = 256, 4, 8192
#: Whole numbers from here on are refused: sums of their products over 10**9 rows would leave 38 digits.
LARGEST = 1 << 47


class Fit(NamedTuple):
    """Of one vector length: rows fitted, sums by dimension, trace of the covariance, eigenvalues (falling) and unit eigenvectors in columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the columns of non-negative ``x`` packed across rows, and each plane's column and power of two."""
    rows, width = x.shape
    bits = [int(v).bit_length() for v in x.max(axis=0)]
    column = np.repeat(np.arange(width), bits)
    power = np.array([p for b in bits for p in range(b)], dtype=np.int64)
    words = -(-rows // 64)
    planes = np.zeros((len(column), words * 8), dtype=np.uint8)
    if len(column):
        packed = np.packbits((x.T[column] >> power[:, None].astype(x.dtype)) & 1 > 0, axis=1)
        planes[:, : packed.shape[1]] = packed
    return planes.view(np.uint64), column, power


def cross_products(x: np.ndarray) -> list[list[int]]:
    """Exact sums over rows of the products of each two columns of whole numbers."""
    rows, width = x.shape
    least = x.min(axis=0)
    shifted = (x - least).astype(np.uint64)
    planes, column, power = bit_planes(shifted)
    counts = np.zeros((len(column), len(column)), dtype=np.int64)
    for k in range(len(column)):
        counts[k, k:] = np.bitwise_count(planes[k:] & planes[k]).sum(axis=1, dtype=np.int64)
    counts = counts + np.triu(counts, 1).T
    small = 2 * int(power.max(initial=0)) + 2 + rows.bit_length() < 62
    weight = np.left_shift(np.int64(1), power) if small else np.array([1 << int(p) for p in power], dtype=object)
    weighted = counts * weight[:, None] * weight[None, :] if len(column) else counts
    starts = np.searchsorted(column, np.arange(width))
    out = np.zeros((width, width), dtype=object)
    if len(column):
        some = np.flatnonzero(np.bincount(column, minlength=width))
        part = np.add.reduceat(np.add.reduceat(weighted, starts[some], axis=0), starts[some], axis=1)
        out[np.ix_(some, some)] = part.astype(object)
    moved, sums = least.astype(object), np.array([int(v) for v in shifted.sum(axis=0)], dtype=object)
    return (out + np.outer(moved, sums) + np.outer(sums, moved) + rows * np.outer(moved, moved)).tolist()


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the lists of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        if n:
            yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)


def grid_rows(df: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """All columns of ``df`` inside ``row``, and ``x``: floor of ``scale`` times each entry; rows without a usable vector go."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    rows = rows.filter(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    whole = F.transform("v", lambda c: F.when(F.abs(c) * scale >= LARGEST, F.raise_error(F.lit(f"entries of {LARGEST // scale} or more are not whitened"))).otherwise(F.floor(c * scale)).cast("long"))
    return rows.select("row", whole.alias("x"))


def product_sums(fit: DataFrame) -> DataFrame:
    """Of the rows of whole numbers ``x``: dim, i, j (i <= j), total; the sums of single dimensions have j = -1, the number of rows i = j = -1."""
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        totals: dict[int, list] = {}

        def add(x: np.ndarray) -> None:
            n, sums, products = totals.get(x.shape[1], (0, 0, 0))
            # Sums of at most BLOCK_ROWS numbers below LARGEST fit 64 bits.
            totals[x.shape[1]] = [n + len(x), sums + x.sum(axis=0).astype(object), products + np.array(cross_products(x), dtype=object)]

        for batch in batches:
            for _, x in _by_length(batch.column("x")):
                held = waiting.setdefault(x.shape[1], [])
                held.append(x)
                if sum(map(len, held)) >= BLOCK_ROWS:
                    whole = np.concatenate(held)
                    for at in range(0, len(whole) - BLOCK_ROWS + 1, BLOCK_ROWS):
                        add(whole[at : at + BLOCK_ROWS])
                    waiting[x.shape[1]] = [rest] if len(rest := whole[len(whole) // BLOCK_ROWS * BLOCK_ROWS :]) else []
        for held in waiting.values():
            if held:
                add(np.concatenate(held))
        for dim, (n, sums, products) in totals.items():
            rows = [(dim, -1, -1, n), *[(dim, i, -1, s) for i, s in enumerate(sums)]]
            rows += [(dim, i, j, products[i, j]) for i in range(dim) for j in range(i, dim)]
            columns = [*zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns[:3]], pa.array([Decimal(int(v)) for v in columns[3]], pa.decimal128(38, 0))], schema=schema)

    parts = fit.select("x").mapInArrow(run, "dim int, i int, j int, total decimal(38,0)")
    return parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))


def fit_whitening(fit: DataFrame) -> dict[int, Fit]:
    """A ``Fit`` for each vector length of the rows ``x``; what comes to the driver is one number a pair of dimensions."""
    totals: dict[int, dict[tuple[int, int], int]] = {}
    for r in product_sums(fit).collect():  # half the square of the vector's length, whatever the rows
        totals.setdefault(r["dim"], {})[r["i"], r["j"]] = int(r["total"])
    out = {}
    for dim, t in totals.items():
        n, sums = t[-1, -1], [t[i, -1] for i in range(dim)]
        covariance = np.array([[Fraction(n * t[min(i, j), max(i, j)] - sums[i] * sums[j], n * n) for j in range(dim)] for i in range(dim)]).astype(float)
        values, vectors = np.linalg.eigh(covariance)
        out[dim] = Fit(n, sums, float(np.trace(covariance)), values[::-1], vectors[:, ::-1])
    return out


def _kept(f: Fit, components: int) -> list[tuple[int, float]]:
    """Components, from 0, with what their projections are divided by; nan where the eigenvalue is 0 but for rounding."""
    floor = len(f.values) * np.finfo(float).eps * max(f.values[0], 0.0)
    return [(k, math.sqrt(f.values[k]) if f.values[k] > floor else math.nan) for k in range(min(components, len(f.values)))]


def _projected(x: np.ndarray, f: Fit, components: int) -> np.ndarray:
    """Whitened coordinates; rows are centred as whole numbers first where these fit 53 bits."""
    bound = max(abs(int(x.max())), abs(int(x.min()))) * f.n + max(abs(s) for s in f.sums)
    if bound < 1 << 53:
        centred = (x * f.n - np.array(f.sums, dtype=np.int64)) / f.n
    else:
        # Whole part and rest of the mean apart, so that the difference rounds once.
        whole = [s // f.n for s in f.sums]
        centred = (x - np.array(whole, dtype=np.int64)) - np.array([float(Fraction(s - w * f.n, f.n)) for s, w in zip(f.sums, whole, strict=True)])
    kept = _kept(f, components)
    with np.errstate(invalid="ignore"):
        return centred @ f.vectors[:, [k for k, _ in kept]] / np.array([root for _, root in kept])


def _deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; none where it leaves 64 bits."""
    bound = max(abs(int(x.max())), abs(int(x.min()))) * f.n + max(abs(s) for s in f.sums)
    if bound * bound * x.shape[1] < 1 << 63:
        d = x * f.n - np.array(f.sums, dtype=np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    d = x.astype(object) * f.n - np.array(f.sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def identity_errors(fit: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS) -> dict[int, float | None]:
    """For each vector length the largest absolute entry of the whitened fit rows' covariance less the identity; none without a component that varies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column("x")):
                w = _projected(x, fits[x.shape[1]], components)
                w = np.column_stack([np.ones(len(w)), w])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + w.T @ w
        rows = [(dim, i, j, float(m[i, j])) for dim, m in sums.items() for i in range(len(m)) for j in range(len(m))]
        yield pa.RecordBatch.from_pylist([dict(zip(("dim", "i", "j", "total"), r, strict=True)) for r in rows], schema=pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())]))

    totals: dict[int, dict] = {}
    for r in fit.select("x").mapInArrow(run, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():  # 25 numbers a vector length
        totals.setdefault(r["dim"], {})[r["i"], r["j"]] = r["total"]
    out = {}
    for dim, t in totals.items():
        use = [k + 1 for k, root in _kept(fits[dim], components) if root == root]
        n = fits[dim].n
        errors = [abs(t[i, j] / n - t[i, 0] / n * (t[0, j] / n) - (i == j)) for i in use for j in use]
        out[dim] = max(errors) if errors else None
    return out


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """All columns of ``df`` in ``row``, and a row a component: component, n, deviation, whitened, explained, identity_error.

    The fit is over distinct grid vectors; ``n`` counts them. Rows whose vector
    is null or holds null or non-finite entries are dropped; an empty vector
    has no components, so no rows. Repeated rows and null ids are rows like
    others. Vectors of each length are fitted on their own. A component whose
    eigenvalue is 0 (fewer distinct vectors than dimensions, equal columns) has
    a null ``whitened``; without any variance ``explained`` and
    ``identity_error`` are null too. ``deviation`` is null where it leaves 64
    bits. Entries of size 2**47 / ``scale`` or more raise an error. An empty
    table gives an empty result.
    """
    grid = grid_rows(df, vector_col, scale)
    fit = materialise(grid.select("x").distinct(), "fit")
    fits = fit_whitening(fit)
    errors = identity_errors(fit, fits, components)
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column("x")):
                f = fits[x.shape[1]]
                w, kept = _projected(x, f, components), _kept(f, components)
                deviation = _deviations(x, f)
                for k, _ in kept:
                    share = float(f.values[k] / f.trace) if f.trace > 0 else None
                    columns = [[k + 1] * len(at), [f.n] * len(at), deviation, pa.array(w[:, k], from_pandas=True), [share] * len(at), [errors.get(x.shape[1])] * len(at)]
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), *[c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names=["row", *names])

    row = grid.schema["row"].dataType.simpleString()
    return grid.mapInArrow(run, f"row {row}, component int, n long, deviation long, whitened double, explained double, identity_error double")
