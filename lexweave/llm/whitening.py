"""Whitening of vectors, with covariances that are exact integers, by a bit-sliced scatter.

Entries become integers (a fixed-point grid).  Each distinct vector counts once for the fit.  A
task takes rows in slices, shifts every dimension by its smallest value there and packs the bit planes of
each dimension across rows into 64-bit words.  The cross-product of two dimensions is the sum over pairs
of their planes of the bits that both have set (AND and popcount), weighted with the planes' places; the shift
is undone in integers.  Tasks hand over sums only, which Spark adds up: half the square of the dimensions in
numbers, whatever the rows.  The driver centres them as integers (``n * C - S * S'``) before it asks for
eigenvectors, and tasks project the rows.

Nulls and edge cases: rows whose vector is null or has a null or non-finite entry are left out, and so are
vectors of another length than most (of lengths equally frequent, the longer).  Entries beyond ``HELD`` grid
steps are held there.  Rows with a null id, and rows that share one, stay.  Directions in which the
fit list does not vary have no component, so equal vectors, a single one or an empty table give no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
HELD = 1 << 61
# Entries of one slice of rows, and words looked at in one step of the scatter.
SLICE_ENTRIES = 1 << 19
STEP_WORDS = 1 << 19
_LIMB = 1 << 64
_LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Moments:
    """Exact sums over the fit list of grid values less ``OFFSET``."""

    count: int
    sums: list[int]
    products: np.ndarray  # of Python ints


@dataclass(frozen=True)
class Whitening:
    """The fit: ``directions`` has a unit eigenvector in each column, ``variances`` their eigenvalues, falling."""

    moments: Moments
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def on_grid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, x)``: grid values less ``OFFSET``, of the rows that can be used."""

    def usable(entry):
        return entry.isNotNull() & (F.abs(entry.cast("double")) < F.lit(float("inf")))

    def placed(entry):
        step = entry.cast("double") * float(SCALE)
        return F.floor(F.greatest(F.lit(-float(HELD)), F.least(F.lit(float(HELD)), step))).cast("long")

    vector = F.col(vector_col)
    return vectors.where(vector.isNotNull() & F.forall(vector, usable)).select(
        F.col(id_col).alias("id"), F.transform(vector, placed).alias("x")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(64, SLICE_ENTRIES // dims)
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            yield part, _matrix(part.column("x"), dims)


def planes(shifted: np.ndarray) -> np.ndarray:
    """``(bits, dims, words)``: bit planes of non-negative integers (rows by dims), packed across rows."""
    bits = max(1, int(shifted.max()).bit_length())
    rows, dims = shifted.shape
    padded = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = shifted.T
    return np.stack(
        [np.packbits((padded >> np.uint64(k)).astype(np.uint8) & 1, axis=1).view(np.uint64) for k in range(bits)]
    )


def scatter(rows: np.ndarray) -> Moments:
    """Sums and cross-products of integer rows, exactly, from bit planes."""
    count, dims = rows.shape
    shift = rows.min(axis=0)
    packed = planes((rows - shift).astype(np.uint64))
    bits, _, words = packed.shape
    kind = np.int64 if 2 * bits + count.bit_length() < 62 else object
    sums, products = np.zeros(dims, kind), np.zeros((dims, dims), kind)
    at_once = max(1, STEP_WORDS // (dims * words))
    for k in range(bits):
        sums += np.bitwise_count(packed[k]).sum(axis=1, dtype=np.int64).astype(kind) * (1 << k)
        for j in range(k, bits):
            common = np.empty((dims, dims), np.int64)
            for first in range(0, dims, at_once):
                both = packed[k][first : first + at_once, None, :] & packed[j][None, :, :]
                common[first : first + at_once] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
            weighted = common.astype(kind) * (1 << (k + j))
            products += weighted if k == j else weighted + weighted.T
    sums, products, shift = sums.astype(object), products.astype(object), shift.astype(object)
    crossed = np.outer(shift, sums)
    return Moments(count, list(sums + count * shift), products + crossed + crossed.T + count * np.outer(shift, shift))


def _summed(fit: DataFrame, dims: int) -> Moments:
    """The moments of all rows; every number travels as two limbs, so that sums cannot overflow."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for _, rows in _slices(batches, dims):
            found = scatter(rows)
            count, sums, products = count + found.count, sums + found.sums, products + found.products
        if not count:
            return
        places = [(-1, -1, count), *((i, -1, int(sums[i])) for i in range(dims))]
        places += [(i, j, int(products[i, j])) for i in range(dims) for j in range(i, dims)]
        limbs = [[decimal.Decimal(total // _LIMB) for *_, total in places], [decimal.Decimal(total % _LIMB) for *_, total in places]]
        yield pa.record_batch(
            {
                "i": pa.array([place[0] for place in places], pa.int32()),
                "j": pa.array([place[1] for place in places], pa.int32()),
                "high": pa.array(limbs[0], pa.decimal128(38, 0)),
                "low": pa.array(limbs[1], pa.decimal128(38, 0)),
            }
        )

    parts = fit.select("x").mapInArrow(partial, "i int, j int, high decimal(38,0), low decimal(38,0)")
    count, sums, products = 0, [0] * dims, np.zeros((dims, dims), object)
    for i, j, high, low in parts.groupBy("i", "j").agg(F.sum("high"), F.sum("low")).collect():
        total = int(high) * _LIMB + int(low)
        if i < 0:
            count = total
        elif j < 0:
            sums[i] = total
        else:
            products[i, j] = products[j, i] = total
    return Moments(count, sums, products)


def decompose(moments: Moments, components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance, which is centred while its entries are still integers."""
    sums = np.array(moments.sums, object)
    centred = moments.count * moments.products - np.outer(sums, sums)
    squared = moments.count**2
    covariance = np.array([[entry / squared for entry in row] for row in centred.tolist()], float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # What rounding leaves of a zero is no variance.
    varies = values > max(values[0], 0) * len(values) * np.finfo(float).eps
    kept = min(components, int(varies.sum()))
    vectors = vectors[:, :kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    trace = sum(centred.diagonal().tolist()) / squared
    return Whitening(moments, vectors * signs, values[:kept], trace)


def _apart(rows: np.ndarray, moments: Moments) -> np.ndarray:
    """``n * x - S`` of each entry, exactly."""
    largest = max(int(np.abs(rows).max(initial=0)) * moments.count, max(abs(total) for total in moments.sums))
    kind = np.int64 if largest < 1 << 61 else object
    return rows.astype(kind) * moments.count - np.array(moments.sums, kind)


def _deviations(apart: np.ndarray) -> list[int | None]:
    """Sums of squares over dimensions; None beyond a long."""
    largest = max((abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0)))))
    exact = apart.astype(np.int64 if largest**2 * apart.shape[1] < _LONGEST else object)
    return [total if total <= _LONGEST else None for total in (exact * exact).sum(axis=1).tolist()]


def _projected(apart: np.ndarray, fit: Whitening) -> np.ndarray:
    return (apart / fit.moments.count).astype(float) @ (fit.directions / np.sqrt(fit.variances))


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity; measured over all its rows."""
    dims, kept = fit.directions.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, kept))
        for _, x in _slices(batches, dims):
            found = _projected(_apart(x, fit.moments), fit)
            total += found.T @ found
        places = np.indices((kept, kept)).reshape(2, -1)
        yield pa.record_batch(
            {"i": pa.array(places[0], pa.int32()), "j": pa.array(places[1], pa.int32()), "total": pa.array(total.ravel())}
        )

    parts = rows.select("x").mapInArrow(partial, "i int, j int, total double")
    covariance = F.sum("total") / float(fit.moments.count)
    worst = parts.groupBy("i", "j").agg(F.abs(covariance - (F.col("i") == F.col("j")).cast("double")).alias("error"))
    return worst.agg(F.max("error")).first()[0]


SCHEMA = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector and component, fitted on every distinct vector.

    ``(id_col, component, n, deviation, whitened, explained, identity_error)``; ``n`` and ``identity_error`` are
    those of the fit, ``deviation`` is null where it is no long.
    """
    spark = vectors.sparkSession
    placed = on_grid(vectors, id_col, vector_col)
    named = f"{_quoted(id_col)} {placed.schema['id'].dataType.simpleString()}, {SCHEMA}"
    distinct = materialize(placed.select("x").distinct(), "grid")
    lengths = distinct.groupBy(F.size("x").alias("dims")).count().where("dims > 0")
    most = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        discard(distinct)
        return spark.createDataFrame([], named)
    dims = most["dims"]
    rows = distinct.where(F.size("x") == dims)
    fit = decompose(_summed(rows, dims), components)
    kept = len(fit.variances)
    if not kept:
        discard(distinct)
        return spark.createDataFrame([], named)
    error = identity_error(rows, fit)
    discard(distinct)
    explained = fit.variances / fit.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, dims):
            apart = _apart(x, fit.moments)
            each = np.repeat(np.arange(len(x)), kept)
            yield pa.record_batch(
                {
                    "id": part.column("id").take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    "deviation": pa.array(_deviations(apart), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(_projected(apart, fit).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                }
            )

    schema = f"id {placed.schema['id'].dataType.simpleString()}, component int, deviation long, whitened double, explained double"
    found = placed.where(F.size("x") == dims).mapInArrow(project, schema)
    return found.select(
        F.col("id").alias(id_col),
        "component",
        F.lit(fit.moments.count).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
