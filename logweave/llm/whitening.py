"""Embedding whitening by polarisation covariance.

An entry c becomes the integer x = floor(256 c).  The covariance comes from
variances alone: Spark sums the exact squared deviations of every dimension and
of the sum of every pair of dimensions, and

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2

gives all cross-covariances; the matrix is assembled for ``eigh``.  All sums are
integers and exact at any size: deviations are n x - S, their squares are added
in tasks and leave them as ``LIMBS`` digits of 32 bits for each dimension or pair,
so what a task, a shuffle and the driver hold grows with the dimensions and
not with the rows.

The fit list is each different x vector once; copies fold in partial aggregates
before the one shuffle, so a vector that holds a third of all rows is one row a
task.  The list is a table, read once for S, once for the squares, once
for the covariance of the whitened values.

Defined cases: rows whose vector is NULL, empty or holds NULL, NaN or infinite entries are
dropped, and so are rows whose vector has not the most frequent number of dimensions
(of equally frequent ones the largest).  Zero vectors stay, so do rows with
a NULL id; repeated rows are returned as often as they occur, extra columns are ignored.
Entries beyond the range of long are held at its ends.  A component whose eigenvalue is zero
to rounding (all of them, where the fit list has one vector) has no scale: its ``whitened``
is NULL and it takes no part in ``identity_error``, which is NULL if none is left.
``explained`` is NULL where all variances are zero.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS = 4
LIMBS = 9
#: Entries of one block of rows in memory, and the most rows of a block.
BLOCK_CELLS, BLOCK_ROWS = 1 << 18, 4096


def as_long(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long") + F.lit(0).cast("long"))


def usable(vector: Column) -> Column:
    """Not NULL, not empty, all entries finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part; one pass counts the lengths."""
    good = rows.where(usable(F.col("embedding"))).select("vec_id", "embedding")
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = lengths["d"] if lengths else 0
    return good.where(F.size("embedding") == size).select("vec_id", as_long(F.col("embedding")).alias("x"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of Arrow batches with their column ``x`` as an int64 matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index("x"))
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // x.shape[1]))
        for i in range(0, len(x), step):
            yield batch.slice(i, step), x[i:i + step]


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


def square_sums(v: np.ndarray, bound: int) -> np.ndarray:
    """Exact sums of the squares of the columns of ``v`` (|v| <= ``bound``), as
    Python integers: in one int64 product where it cannot overflow, else with
    every v as high * 2^25 + low, else in Python's integers."""
    def total(a, b):
        return np.einsum("ij,ij->j", a, b).astype(object)

    if len(v) * bound * bound < 1 << 63:
        return total(v, v)
    if bound < 1 << 50 and v.dtype != object:
        high, low = v >> 25, v & 0x1FFFFFF
        return total(high, high) * (1 << 50) + total(high, low) * (1 << 26) + total(low, low)
    return (v.astype(object) ** 2).sum(axis=0)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, int]:
    """n x - S, in int64 where every value and every sum of two fits, and a
    bound of the values."""
    bound = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
    if bound < 1 << 61:
        return x * n - np.array(sums, dtype=np.int64), bound
    return x.astype(object) * n - np.array(sums, dtype=object), bound


def limbs(value: int) -> list[int]:
    """A non-negative integer as digits of 32 bits, lowest first; the last is open."""
    return [(value >> (32 * k)) & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> (32 * (LIMBS - 1))]


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and its exact sums a dimension."""
    def partial(batches):
        n, total = 0, None
        for _, x in blocks(batches):
            n, total = n + len(x), column_sums(x) + (0 if total is None else total)
        if n:
            # a bias keeps the digits non-negative
            rows = [[i, n, *limbs(int(t) + (n << 64))] for i, t in enumerate(total)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["i", "n", *digit])

    digit = [f"l{k}" for k in range(LIMBS)]
    parts = fit.select("x").mapInArrow(partial, "i long, n long, " + ", ".join(f"{c} long" for c in digit))
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in digit]).orderBy("i").collect()
    n = rows[0]["n"] if rows else 0
    return n, [sum(r[c] << (32 * k) for k, c in enumerate(digit)) - (n << 64) for r in rows]


def squared_deviations(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over the fit list of (n x_i - S_i)^2, under (i, i), and of
    ((n x_i - S_i) + (n x_j - S_j))^2, under (i, j) with i < j."""
    dims = len(sums)

    def partial(batches):
        total = [0] * dims
        seen = False
        for _, x in blocks(batches):
            seen = True
            v, bound = deviations(x, n, sums)
            for i in range(dims):
                pairs = v[:, i:] + v[:, i:i + 1]
                pairs[:, 0] = v[:, i]
                total[i] = total[i] + square_sums(pairs, 2 * bound)
        if seen:
            rows = [[i, i + k, *limbs(int(t))] for i in range(dims) for k, t in enumerate(total[i])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["i", "j", *digit])

    digit = [f"l{k}" for k in range(LIMBS)]
    parts = fit.select("x").mapInArrow(partial, "i long, j long, " + ", ".join(f"{c} long" for c in digit))
    rows = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in digit]).collect()
    return {(r["i"], r["j"]): sum(r[c] << (32 * k) for k, c in enumerate(digit)) for r in rows}


def covariance(squares: dict[tuple[int, int], int], n: int, dims: int) -> np.ndarray:
    """Differences of variances as covariances of x, each rounded once."""
    out = np.empty((dims, dims))
    for (i, j), s in squares.items():
        if i == j:
            out[i, i] = s / n ** 3
        else:
            out[i, j] = out[j, i] = (s - squares[i, i] - squares[j, j]) / (2 * n ** 3)
    return out


def axes(cov: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading eigenvalues and unit eigenvectors (rows), and the trace; the
    largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:count]
    u = vectors[:, order].T
    u = u * np.sign(u[np.arange(len(u)), np.abs(u).argmax(axis=1)])[:, None]
    return values[order], u, float(np.trace(cov))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row of ``rows`` (vec_id, embedding) and component:
    vec_id, component, n, deviation (decimal(38, 0), NULL beyond it), whitened,
    explained, identity_error."""
    x = integer_vectors(rows)
    fit = materialize(x.select("x").distinct())
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    n, sums = moments(fit)
    if not n:
        none = x.selectExpr("vec_id", "1 component", "0L n", "cast(0 as decimal(38,0)) deviation", "0D whitened",
                            "0D explained", "0D identity_error")
        return none.where("false")
    e, u, trace = axes(covariance(squared_deviations(fit, n, sums), n, len(sums)), min(components, len(sums)))
    live = e > len(sums) * np.finfo(float).eps * max(e[0], 0.0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), np.nan)
    explained = [float(v) / trace if trace > 0 else None for v in e]

    def project(v: np.ndarray) -> np.ndarray:
        return (v.astype(float) / n) @ u.T * scale

    def whitened_only(batches):
        for _, block in blocks(batches):
            w = project(deviations(block, n, sums)[0])
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(len(e))], names)

    names = [f"w{k}" for k in range(len(e))]
    w = fit.select("x").mapInArrow(whitened_only, ", ".join(f"{c} double" for c in names))
    kept = [k for k in range(len(e)) if live[k]]
    error = None
    if kept:
        cov = w.agg(*[F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a in kept for b in kept if a <= b]).first()
        error = max(abs(cov[f"c{a}_{b}"] - (a == b)) for a in kept for b in kept if a <= b)

    def output(batches):
        k = len(e)
        for part, block in blocks(batches):
            v, bound = deviations(block, n, sums)
            if len(sums) * bound * bound < 1 << 63:
                dev = [int(d) for d in (v * v).sum(axis=1)]
            else:
                dev = [int(d) for d in (v.astype(object) ** 2).sum(axis=1)]
            dev = pa.array([Decimal(d) if d < 10 ** 38 else None for d in dev], pa.decimal128(38, 0))
            white = project(v).ravel()
            again = np.repeat(np.arange(len(v)), k)
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("vec_id")).take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))),
                pa.array(np.full(len(again), n, dtype=np.int64)), dev.take(pa.array(again)),
                pa.array(white, mask=np.isnan(white)), pa.array(explained * len(v), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return x.mapInArrow(output, schema).withColumn("identity_error", F.lit(error).cast("double"))
