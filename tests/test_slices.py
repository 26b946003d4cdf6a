"""Batches are turned into Python values a few rows at a time."""

import pyarrow as pa

from briefloom.functions.tables import SLICE, by_slices
from briefloom.operators import extraction


def test_a_batch_is_made_by_slices():
    seen = []
    run = by_slices(lambda a, b: seen.append(len(a)) or [None if x is None else x * y for x, y in zip(a, b)], pa.int64())
    n = 3 * SLICE + 5
    a = pa.array([None if k % 7 == 0 else k for k in range(n)])
    assert run(a, pa.array([2] * n)).to_pylist() == [None if k % 7 == 0 else 2 * k for k in range(n)]
    assert max(seen) == SLICE and sum(seen) == n and run(a.slice(0, 0), a.slice(0, 0)).to_pylist() == []


def test_answers_leave_by_slices():
    batch = pa.RecordBatch.from_pylist([{"id": str(k), "text": "x"} for k in range(2 * SLICE + 1)])
    out = list(extraction._asked(lambda row: row["id"])(iter([batch])))
    assert [b.num_rows for b in out] == [SLICE, SLICE, 1] and [x for b in out for x in b["answer"].to_pylist()] == batch["id"].to_pylist()
