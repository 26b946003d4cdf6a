"""The bound on a batch's bytes holds in sessions that have not set one of their own."""

import pytest

from briefloom.functions import tables

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounds():
    yield tables.small_batches
    try:
        from briefloom.llm import scratch
    except ImportError:
        return
    yield scratch.small_batches


@pytest.mark.parametrize("bound", bounds())
@pytest.mark.parametrize("own, then", [(None, 4 << 20), ("1024", 1024), ("67108864b", 4 << 20), ("64m", 4 << 20)])
def test_batches_are_bounded(spark, bound, own, then):
    before = spark.conf.get(KEY)
    try:
        spark.conf.unset(KEY) if own is None else spark.conf.set(KEY, own)
        bound(spark)
        assert int(spark.conf.get(KEY)) == then
    finally:
        spark.conf.set(KEY, before)
