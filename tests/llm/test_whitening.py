"""Whitening against plain sums of fractions, and its defined cases."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from briefloom.llm import whitening

NAN, INF = float("nan"), float("inf")


def plain(rows):
    """From (id, vector): the x vectors that take part, the fit list, its covariance as fractions."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    return kept, fit, sums, cov


def checked(spark, rows, d, schema="vec_id bigint, embedding array<double>"):
    kept, fit, sums, cov = plain(rows)
    n = len(fit)
    got = whitening.whitened(spark.createDataFrame(rows, schema).repartition(5)).select("vec_id", "embedding", "white.*").collect()
    assert len(got) == len(kept)
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    by_x = {}
    for r in got:
        x = tuple(math.floor(256 * c) for c in r.embedding)
        assert r.n == n and int(r.own.deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        by_x[x] = r.own["values"]
        assert np.allclose(r.explained, values[:4] / sum(values), rtol=1e-9)
        assert r.identity_error < 1e-9
    centred = np.array([[float(a - Fraction(s, n)) for a, s in zip(x, sums)] for x in fit])
    want = centred @ axes[:, :4] / np.sqrt(values[:4])
    have = np.array([by_x[x] for x in fit])
    for k in range(min(4, d)):
        assert min(np.abs(have[:, k] - want[:, k]).max(), np.abs(have[:, k] + want[:, k]).max()) < 1e-9
    return got


def test_equals_fractions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(0, [1, 2, 0.3, 5, 0.1, 1])]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)] + [rows[3], (None, rows[4][1]), (1, None), (2, [NAN] * 6), (3, [1.0, None] + [0.0] * 4), (4, [INF] * 6)]
    checked(spark, rows, 6)


def test_far_from_the_origin_and_large(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1e6 + float(a), -3e9 + 100 * float(b), 5e6 + 10 * float(c)]) for i, (a, b, c) in enumerate(rng.normal(0, 1, (80, 3)))]
    checked(spark, rows, 3)


def test_given_table(spark):
    got = whitening.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert [*got.columns] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    _, fit, sums, cov = plain([(r.vec_id, r.embedding) for r in rows])
    n, by_id = len(fit), {r.vec_id: r.embedding for r in rows}
    found = got.collect()
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {n}
    assert all(r.deviation == sum((n * math.floor(256 * c) - s) ** 2 for c, s in zip(by_id[r.vec_id], sums)) for r in found)
    values = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))[::-1]
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-6 for r in found)


def test_without_variance_short_and_empty(spark):
    schema = "vec_id bigint, embedding array<float>, white int"
    flat = whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0], 7), (1, [0.5, 1.0], 8)], schema).drop("white")).select("white.*").collect()
    assert [(r.n, int(r.own.deviation), r.own["values"], r.explained, r.identity_error) for r in flat] == [(1, 0, [None, None], [None, None], None)] * 2
    line = whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5]), (3, [])], "vec_id bigint, embedding array<float>")).select("vec_id", "white.*").collect()
    assert len(line) == 3 and {r.n for r in line} == {3}
    assert whitening.whitened(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")).where(F.col("white.n") > 0).collect() == []
