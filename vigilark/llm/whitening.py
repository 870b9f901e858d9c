"""Embedding whitening from a polarisation covariance.

Vectors become integers, ``x = floor(256 * c)``, so every sum below is exact. With n distinct vectors
and their sums S, a centred value is the integer ``y = n * x - S``. The only second moments taken are
squares: of every dimension, ``Q(i) = sum(y_i^2)``, and of every sum of two dimensions,
``Q(i, j) = sum((y_i + y_j)^2)``. The differences give the covariances (polarisation):
``n^3 * V(i, j) = (Q(i, j) - Q(i) - Q(j)) / 2``; exact integers up to one correctly rounded division.
The matrix of d x d goes to ``numpy.linalg.eigh``.

A task keeps one integer a pair of dimensions, whatever its rows, and sends it in pieces of 60 bits
that Spark sums as decimals, so no sum can overflow; to the driver go d (d + 1) / 2 sums. Repeated
vectors are one vector of the fit list; they meet map-side, so a vector that a third of the rows share
costs a row a partition. The fit list is a checkpoint in the shared folder, read three times (sums,
squares, check of the result). ``identity_error`` is measured on the whitened fit list, not derived.

Inputs: vectors that are null or empty, or hold null or non-finite entries, take no part and get no
row. Nor do vectors whose length is not the commonest one (ties: the longer). Entries beyond the range
of a long are its ends. Repeated and null ``vec_id`` each give their rows. Components whose eigenvalue
is zero (to rounding) have no whitened value and are left out: one distinct vector, or none, gives no
rows. A deviation past 64 bits is null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import saved

COMPONENTS = 4
#: bits of a piece of a sum, and rows that are squared at a time
PIECE, ROWS = 60, 8192
SUMS = "key int, piece int, value decimal(38,0)"
OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
       "identity_error double")


def integers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x: array of long) of the vectors that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return (embeddings.filter(v.isNotNull() & (F.size(v) > 0) & finite)
            .select("vec_id", F.transform(v, lambda c: F.floor(c.cast("double") * 256)).alias("x")))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n * x - s``; as Python integers where 62 bits may not hold it (two are added later)."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, s)) < 2 ** 61:
        return x * np.int64(n) - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return [int(v) for v in (x if most * len(x) < 2 ** 63 else x.astype(object)).sum(axis=0)]


def square_sum(p: np.ndarray) -> list[int]:
    """Sums of the squares of the columns (of at most ``ROWS`` rows) as Python integers."""
    if p.dtype != object:
        most = max(int(p.max(initial=0)), -int(p.min(initial=0)))
        if most * most * len(p) < 2 ** 63:
            return [int(v) for v in (p * p).sum(axis=0)]
        if most < 2 ** 47:      # p = high * 2^24 + low: three sums that fit
            high, low = p >> 24, p & (2 ** 24 - 1)
            parts = zip((high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0))
            return [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in parts]
        p = p.astype(object)
    return [int(v) for v in (p * p).sum(axis=0)]


def pieces(totals: list[int]) -> pa.RecordBatch:
    """(key, piece, value): every total as signed pieces of ``PIECE`` bits."""
    rows = []
    for key, total in enumerate(totals):
        sign, rest, piece = (-1 if total < 0 else 1), abs(total), 0
        while rest or piece == 0:
            rows.append((key, piece, sign * (rest & (2 ** PIECE - 1))))
            rest, piece = rest >> PIECE, piece + 1
    key, piece, value = map(list, zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int32()), pa.array(piece, pa.int32()),
         pa.array(value, pa.int64()).cast(pa.decimal128(38, 0))], ["key", "piece", "value"])


def totals_of(df: DataFrame, size: int) -> list[int]:
    """The sums of ``pieces`` over all tasks (``size`` numbers)."""
    out = [0] * size
    for r in df.groupBy("key", "piece").agg(F.sum("value").alias("value")).collect():
        out[r["key"]] += int(r["value"]) << (PIECE * r["piece"])
    return out


def _count_and_sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for b in batches:
            total = [t + v for t, v in zip(total, [*exact_sum(matrix(b["x"])), b.num_rows])]
        if total[d]:
            yield pieces(total)
    return run


def _squares(n: int, s: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, seen = len(s), False
        total = [0] * (d * (d + 1) // 2)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y, key, seen = centred(matrix(b["x"].slice(at, ROWS)), n, s), 0, True
                for i in range(d):      # dimension i itself, then its sum with each later one
                    p = y[:, i:] + y[:, i:i + 1]
                    p[:, 0] = y[:, i]
                    for v in square_sum(p):
                        total[key] += v
                        key += 1
        if seen:
            yield pieces(total)
    return run


def covariance(q: list[int], n: int, d: int) -> np.ndarray:
    """V from the square sums, by polarisation; each entry rounded once."""
    at = [0] * (d + 1)
    for i in range(d):
        at[i + 1] = at[i] + d - i
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = q[at[i]] / n ** 3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = ((q[at[i] + j - i] - q[at[i]] - q[at[j]]) // 2) / n ** 3
    return v


def _moments(n: int, s: list[int], w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.shape[1]
        total = np.zeros(k * k + k)
        for b in batches:
            z = (centred(matrix(b["x"]), n, s).astype(float) / n) @ w
            total += np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["key", "value"])
    return run


def _project(n: int, s: list[int], w: np.ndarray, explained: list[float], error: float):
    k = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = centred(matrix(b["x"]), n, s)
            most = max(int(y.max(initial=0)), -int(y.min(initial=0)))
            far = y if most * most * y.shape[1] < 2 ** 63 else y.astype(object)
            dev = [v if v < 2 ** 63 else None for v in map(int, (far * far).sum(axis=1))]
            z = (y.astype(float) / n) @ w
            rows = np.repeat(np.arange(len(dev)), k)
            yield pa.RecordBatch.from_arrays([
                b["vec_id"].take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(dev))),
                pa.array(np.full(len(rows), n)), pa.array(dev, pa.int64()).take(pa.array(rows)), pa.array(z.ravel()),
                pa.array(np.tile(explained, len(dev))), pa.array(np.full(len(rows), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    spark = embeddings.sparkSession
    rows = integers(embeddings, vector)
    size = F.size("x")
    common = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], OUT)
    d = common["d"]
    rows = rows.filter(size == d)
    fit = saved(rows.select("x").distinct())
    *s, n = totals_of(fit.mapInArrow(_count_and_sums(d), SUMS), d + 1)
    q = totals_of(fit.mapInArrow(_squares(n, s), SUMS), d * (d + 1) // 2)
    v = covariance(q, n, d)
    e, u = np.linalg.eigh(v)
    order = [i for i in np.argsort(-e, kind="stable") if e[i] > d * np.finfo(float).eps * abs(e).max()][:components]
    if not order:
        return spark.createDataFrame([], OUT)
    w = u[:, order] / np.sqrt(e[order])
    k = len(order)
    sums = np.zeros(k * k + k)
    for r in fit.mapInArrow(_moments(n, s, w), "key int, value double").groupBy("key").agg(F.sum("value").alias("v")).collect():
        sums[r["key"]] = r["v"]
    mean = sums[k * k:] / n
    error = float(abs(sums[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = [float(e[i] / np.trace(v)) for i in order]
    return rows.mapInArrow(_project(n, s, w, explained, error), OUT)
