"""Hard negatives against brute force over all rows, and the SQL."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from briefloom.llm import hardneg

NAN, INF = float("nan"), float("inf")


def plain(rows, anchor, positives=5, negatives=5):
    """From (id, label, vector): the operator's rows, by scoring everything."""
    d = max((len(v) for _, _, v in rows if v), default=0)
    own = [(math.inf if i is None else i, y, [math.floor(256 * c) for c in v] + [0] * (d - len(v))) for i, y, v in rows if y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    shown = lambda i: None if i == math.inf else i
    out = []
    for k, (i, y, x) in enumerate(own):
        if i == math.inf or not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(x, w)), j, z == y) for m, (j, z, w) in enumerate(own) if m != k]
        for s, j, _ in sorted(t for t in scored if t[2])[:positives]:
            fit = sorted(t for t in scored if not t[2] and -80 * s <= -100 * t[0] <= -100 * s)[:negatives]
            out += [(i, shown(j), r + 1, shown(t[1]), -s, -t[0]) for r, t in enumerate(fit)]
    return sorted(out, key=str)


def checked(spark, rows, **bounds):
    docs = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("key", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    got = sorted(map(tuple, hardneg.hard_negatives(docs, F.col("vec_id") % 5 == 0).collect()), key=str)
    assert got == plain(rows, lambda i: i % 5 == 0)
    return got


@pytest.mark.parametrize("kind", ["clusters", "lengths", "small", "odd"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hardneg, "BUCKET", 32)
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    rng = np.random.default_rng(5)
    if kind == "clusters":
        centres = rng.normal(0, 1, (4, 8))
        rows = [(i, i % 3, (centres[i % 4] + rng.normal(0, 0.3, 8)).tolist()) for i in range(240)]
    elif kind == "lengths":
        rows = [(i, int(rng.integers(2)), (rng.normal(0, 1, 6) * 10 ** rng.uniform(-2, 4)).tolist()) for i in range(240)]
    elif kind == "small":  # many ties, zero vectors, negative scores
        rows = [(i, int(rng.integers(3)), (rng.integers(-1, 2, 3) / 256).tolist()) for i in range(240)]
    else:
        rows = [(i, i % 2, rng.normal(0, 1, 4).tolist()) for i in range(60)]
        rows += [(10, 0, rows[3][2]), (10, 0, rows[3][2]), (None, 1, rows[10][2]), (None, 0, rows[10][2]), (65, None, [1.0] * 4), (70, 1, None), (75, 1, [NAN] * 4), (80, 1, [1.0, None]), (85, 0, [INF]), (90, 1, [1.0]), (95, 0, []), (100, 7, [9.0] * 4)]
        rows += [(200 + i, 1, rows[5][2]) for i in range(40)]
    assert checked(spark, rows)


def test_empty_and_without_anchors(spark):
    schema = "vec_id bigint, label int, embedding array<float>"
    for rows in ([], [(1, 1, [1.0])], [(None, 1, [1.0])], [(100, 1, [1.0])]):
        assert hardneg.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect() == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    assert checked(spark, [(i, i % 2, (rng.normal(0, 4e4, 5) + 9e4).tolist()) for i in range(60)])


def test_pruning_leaves_rows_out_and_none_that_counts():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (500, 8))
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 4096).astype(np.int64)
    batch = pa.record_batch([pa.array(range(500), pa.int64()), pa.array(range(500), pa.int64()), pa.array([0] * 500, pa.int64()), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["key", "id", "label", "x"])
    bucket = hardneg.Bucket(next(hardneg._buckets(iter([batch]))).to_pylist()[0])
    anchor = {"key": np.array([1000]).tobytes(), "label": np.array([0]).tobytes(), "x": hardneg._small(x[:1]), "low": np.array([0]).tobytes(), "high": np.array([0]).tobytes()}
    search = hardneg.Search(anchor, True, 5)
    scores = x @ x[0]
    seen = []
    for low, high in [(int(np.sort(scores)[-4]), 1 << 40), (int(np.sort(scores)[-9]), int(np.sort(scores)[-5])), (-(1 << 62), 1 << 62), (-(1 << 62), int(np.sort(scores)[3])), (0, 0)]:
        got = search.candidates(0, low, high, bucket)
        assert set(np.flatnonzero((scores >= low) & (scores <= high))) <= set(got)
        seen.append(len(got))
    assert seen[0] < 250 and seen[2] == 500, seen


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    got = hardneg.op11_hard_negatives(spark, folder)
    found = connection.execute(hardneg.OP11_SQL)
    assert got.columns == [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert want and sorted(map(tuple, got.collect())) == want
