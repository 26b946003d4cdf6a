"""Whitening of embeddings from exact integer sums, by the polarisation identity.

An entry c becomes the integer x = floor(256 c).  The fit list holds each distinct x vector once.

1. One pass over the fit list: the number n and the sum of every dimension.
2. A second pass: entries are centred by their rounded mean, z = x - m, and for every dimension i and every
   sum i + j of two dimensions the squares z_i^2 and (z_i + z_j)^2 are added up exactly, in each
   task first and then over the tasks: d (d + 1) / 2 numbers, whatever the rows.  The rest of the mean,
   t / n, leaves by n * sum(z^2) - t^2, still in integers.
3. cov(i, j) = (var(i + j) - var(i) - var(j)) / 2 gives every cross-covariance as an exact fraction; the
   matrix, rounded once to doubles, goes to `eigh`.  It is d x d, so it may be held in one place.
4. Rows are projected in parallel; the covariance of what came out is measured over the fit list.

Rows whose vector is null or has a null or non-finite entry take no part.  Entries are held within ±2^40
after scaling; shorter vectors count as filled up with zeros.  Repeated rows and rows of one id are each
returned; a null id is kept.  A component without variance has a null `whitened`, `explained` is null where
there is no variance at all, and an empty table gives an empty result.  There are at most d components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import staged
from .textscan import release
from .vectors import integers, is_whole, matrices, matrix, padded

LIMIT = 1 << 40
#: Rows that are squared at once.
ROWS = 2048
_WIDE = pa.decimal128(38, 0)
_EXACT = Context(prec=60)
_SUMS = "k bigint, total decimal(38,0)"


class Fit(NamedTuple):
    """What the fit list says: its rows, sums of x, unit axes (columns, by falling eigenvalue), eigenvalues, and the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float


def _sums(rows: DataFrame, column: str, of) -> dict[int, int]:
    """Exact sums over all rows, by number; of: from a matrix of vectors the sums of its rows, as Python integers.
    Every task sends one row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = None
        for block in matrices(batches, column, ROWS):
            own = of(block)
            total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int64()), pa.array([_EXACT.create_decimal(int(x)) for x in total], _WIDE)], names=["k", "total"])

    found = rows.select(column).mapInArrow(run, _SUMS).groupBy("k").agg(F.sum("total").alias("total")).collect()
    return {r.k: int(r.total) for r in found}


def _exact(block: np.ndarray, most: int) -> np.ndarray:
    """block, as Python integers if entries exceed what is safe to square and add in 64 bits."""
    return block if not block.size or int(np.abs(block).max()) <= most else block.astype(object)


def pair_squares(centre: np.ndarray):
    """Of a block: the sums of z_i^2 at i, then of (z_i + z_j)^2 for i < j in order."""

    def of(block: np.ndarray) -> np.ndarray:
        z = _exact(block - centre, 1 << 24)
        each = [(z * z).sum(axis=0)]
        for i in range(z.shape[1] - 1):
            both = z[:, i : i + 1] + z[:, i + 1 :]
            each.append((both * both).sum(axis=0))
        return np.concatenate(each).astype(object)

    return of


def fitted(distinct: DataFrame, column: str, d: int) -> Fit | None:
    """The fit over rows of distinct vectors of length d; None without any."""
    first = _sums(distinct, column, lambda block: np.concatenate([[len(block)], _exact(block, 1 << 50).sum(axis=0)]).astype(object))
    if not first or not d:
        return None
    n, sums = first[0], [first[i + 1] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    found = _sums(distinct, column, pair_squares(np.array(centre, np.int64)))
    spread = [n * found[i] - rest[i] ** 2 for i in range(d)]  # n^2 times the variance
    cov, k = np.zeros((d, d)), d
    for i in range(d):
        cov[i, i] = spread[i] / n**2
        for j in range(i + 1, d):
            both = n * found[k] - (rest[i] + rest[j]) ** 2
            cov[i, j] = cov[j, i] = (both - spread[i] - spread[j]) / (2 * n**2)
            k += 1
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    values = np.where(values > values[0] * d * 1e-15, values, 0.0) if values[0] > 0 else np.zeros(d)
    largest = axes[np.argmax(np.abs(axes), axis=0), np.arange(d)]
    return Fit(n, sums, axes * np.where(largest < 0, -1.0, 1.0), values, sum(spread) / n**2)


def _offsets(fit: Fit) -> tuple[np.ndarray, list[int]]:
    """The rounded mean m, and n times what the mean is beyond it."""
    centre = [(2 * s + fit.n) // (2 * fit.n) for s in fit.sums]
    return np.array(centre, np.int64), [s - fit.n * m for s, m in zip(fit.sums, centre)]


def projected(block: np.ndarray, fit: Fit, components: int) -> np.ndarray:
    """Rows less their mean on the first axes, each to variance one; not a number where there is none."""
    centre, rest = _offsets(fit)
    scale = np.sqrt(fit.values[:components])
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((block - centre) - np.array(rest, float) / fit.n) @ fit.axes[:, :components] / np.where(scale > 0, scale, np.nan)


def deviations(block: np.ndarray, fit: Fit) -> list[int]:
    """Of each row the sum over dimensions of (n x - S)^2, exactly: n^2 sum(z^2) - 2 n sum(z t) + sum(t^2)."""
    centre, rest = _offsets(fit)
    small = max(map(abs, rest)) * max(1, len(rest)) < 1 << 34
    z = _exact(block - centre, (1 << 24) if small else 0)
    squares, cross = (z * z).sum(axis=1), (z * np.array(rest, z.dtype)).sum(axis=1)
    own, n = sum(t * t for t in rest), fit.n
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, cross)]


def identity_error(distinct: DataFrame, column: str, fit: Fit, components: int) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over the fit list, without axes of no variance."""
    k = int((fit.values[:components] > 0).sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for block in matrices(batches, column, ROWS):
            own = projected(block, fit, k)
            total += np.column_stack([own.T @ own, own.sum(axis=0)])
        yield pa.record_batch([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["k", "total"])

    found = distinct.select(column).mapInArrow(run, "k bigint, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k, k + 1))
    for r in found:
        total.ravel()[r.k] = r.total
    mean = total[:, k] / fit.n
    return float(np.abs(total[:, :k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """rows that take part, with `white`: a struct of the fit's n, the row's deviation (null beyond 38 digits),
    values (one for each component, null without variance), explained shares, and the identity error."""
    schema = "struct<deviation: decimal(38,0), values: array<double>>"
    told = lambda white: rows.where(is_whole(F.col(vector))).withColumn("white", white)
    x = rows.where(is_whole(F.col(vector))).select(integers(F.col(vector), LIMIT).alias("x"))
    x, d = padded(x, "x")
    distinct = staged(x.distinct(), "fit")
    fit = fitted(distinct, "x", d)
    if fit is None:
        empty = f"struct<n: bigint, own: {schema}, explained: array<double>, identity_error: double>"
        return told(F.lit(None).cast(empty)).where(F.lit(False))
    most = min(components, d)

    def of(column: pa.Array) -> pa.Array:
        release()
        block = matrix(column)
        wide = [_EXACT.create_decimal(v) if v < 10**38 else None for v in deviations(block, fit)]
        values = projected(block, fit, most).ravel()
        lists = pa.ListArray.from_arrays(pa.array(range(0, len(values) + 1, most), pa.int32()), pa.array(values, from_pandas=True))
        return pa.StructArray.from_arrays([pa.array(wide, _WIDE), lists], names=["deviation", "values"])

    own = integers(F.col(vector), LIMIT)
    own = F.concat(own, F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size(own)))
    shares = [F.lit(float(v / fit.trace) if fit.trace > 0 else None).cast("double") for v in fit.values[:most]]
    error = F.lit(identity_error(distinct, "x", fit, most)).cast("double")
    return told(F.struct(F.lit(fit.n).cast("bigint").alias("n"), F.arrow_udf(of, schema)(own).alias("own"), F.array(*shares).alias("explained"), error.alias("identity_error")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    each = whitened(rows).select("vec_id", "white.n", F.expr("try_cast(white.own.deviation AS bigint)").alias("deviation"), "white.identity_error", F.posexplode(F.arrays_zip("white.own.values", "white.explained")).alias("at", "own"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("own.values").alias("whitened"), F.col("own.explained").alias("explained"), "identity_error")
