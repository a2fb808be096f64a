"""Embedding whitening by upper-triangle column aggregates.

Vectors are put on an integer grid. One aggregation over the distinct grid vectors sums the centred products of every pair of
dimensions i <= j, each a generated SQL expression of its own; the covariance assembled from them is decomposed by LAPACK.
Columns are centred on the whole number next to their mean before they are multiplied, so products are whole numbers, sums of
up to 2**53 are exact in any order, and what is left of the mean is taken off exactly, in whole numbers, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.scratch import forget, written

SCALE, OFFSET = 64, 1_000_000
#: Grid values beyond it would not be exact as doubles.
_LARGEST = 2.0**52


@dataclass(frozen=True)
class Whitening:
    """n grid vectors, their sums, the eigenvalues above rounding and their unit eigenvectors (columns), the trace, and the check of the fit."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def _on_grid(vector: Column) -> Column:
    def one(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(c.cast("double")) * SCALE < _LARGEST, scaled + OFFSET).otherwise(F.raise_error(F.lit("an entry is too large for the grid")).cast("long")).cast("long")

    return F.transform(vector, one)


def on_grid(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): x = floor(64 * c) + 1000000 of each entry c. Rows whose vector is null or holds a null, NaN or infinite entry go."""
    return rows.filter(_usable(F.col(vector))).select(key, _on_grid(F.col(vector)).alias("x"))


def _sums(grid: DataFrame, d: int) -> tuple[int, list[int]]:
    found = grid.selectExpr("count(1) AS n", *(f"sum(x[{i}]) AS s{i}" for i in range(d))).first()
    return found.n, [found[f"s{i}"] for i in range(d)]


def covariance(grid: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the vectors x of grid: one aggregation with an expression for each pair of dimensions."""
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]  # what the columns still sum to
    centred = grid.selectExpr(*(f"CAST(x[{i}] - {centre[i]}L AS DOUBLE) AS y{i}" for i in range(d)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    products = centred.selectExpr(*(f"sum(y{i} * y{j}) AS p{i}_{j}" for i, j in pairs)).first()
    out = np.zeros((d, d))
    for (i, j), p in zip(pairs, products, strict=True):
        out[i, j] = out[j, i] = (n * int(p) - left[i] * left[j]) / n**2  # whole numbers up to the last division
    return out


def _projected(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch: itself, n * x - S as whole numbers, and the whitened coordinates."""
    d, sums = len(model.sums), np.array(model.sums, np.int64)
    for batch in batches:
        x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, d)
        wide = model.n * max(int(np.abs(x).max(initial=0)), 1) >= 1 << 62
        away = x.astype(object) * model.n - sums.astype(object) if wide else x * np.int64(model.n) - sums
        yield batch, away, (away / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.values)


def _coordinates(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    for _, _, w in _projected(batches, model):
        yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.list_(pa.float64()))], names=["w"])


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening, key: str) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for batch, away, w in _projected(batches, model):
        narrow = away.dtype == np.int64 and int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < 1 << 63
        squares = (away**2).sum(axis=1) if narrow else [sum(int(a) ** 2 for a in row) for row in away]
        at = np.repeat(np.arange(batch.num_rows), k)
        yield pa.RecordBatch.from_arrays(
            [batch.column(key).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(squares, pa.int64()).take(pa.array(at)), pa.array(w.ravel())],
            names=[key, "component", "deviation", "whitened"],
        )


def fit(grid: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors x of grid; None without a vector or without a dimension.

    Up to `components` eigenvectors are kept, numbered by falling eigenvalue, each with its largest entry positive. A direction
    whose eigenvalue is rounding only (constant or dependent dimensions, fewer vectors than dimensions) has no unit variance to
    scale to and is left out. All vectors must be of one length, else this raises.
    """
    distinct = written(grid.select("x").distinct(), "grid")
    shape = distinct.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not shape.high:
        return None
    if shape.low != shape.high:
        raise ValueError(f"vectors have {shape.low} to {shape.high} entries")
    n, sums = _sums(distinct, shape.high)
    v = covariance(distinct, n, sums)
    values, vectors = np.linalg.eigh(v)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > len(v) * np.finfo(float).eps * max(values.max(), 0.0)]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if order else vectors
    model = Whitening(n, sums, values, vectors, float(np.trace(v)))
    error = _identity_error(distinct, model)
    forget(distinct)
    return Whitening(n, sums, values, vectors, model.trace, error)


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    w = distinct.mapInArrow(partial(_coordinates, model=model), "w array<double>").selectExpr(*(f"w[{i}] AS w{i}" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.selectExpr(*(f"covar_pop(w{i}, w{j}) AS c{i}_{j}" for i, j in pairs)).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component.

    deviation is the sum of (n * x - S)**2 over the dimensions, exact (a sum beyond 64 bits raises); whitened is x - S / n on the
    component, over the root of its eigenvalue; explained is the eigenvalue's share of the trace. Rows with a null vector, or a
    null, NaN or infinite entry, go; repeated rows each have their rows, but count once in the fit; a null key stays. An empty
    table, empty vectors and vectors that are all equal give no rows. Vectors of several lengths, and entries of 2**46 or more,
    raise. Further columns are ignored. The plan holds a sum for each pair of dimensions, so their number must stay in the low
    hundreds.
    """
    grid = on_grid(rows, key, vector)
    model = fit(grid, components)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, deviation long, whitened double"
    if model is None or not len(model.values):
        out = rows.sparkSession.createDataFrame([], schema)
        n, error, shares = 0, 0.0, [0.0]
    else:
        out = grid.mapInArrow(partial(_whitened, model=model, key=key), schema)
        n, error, shares = model.n, model.identity_error, [float(e / model.trace) for e in model.values]
    explained = F.get(F.array(*map(F.lit, shares)), F.col("component") - 1)
    return out.select(key, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
