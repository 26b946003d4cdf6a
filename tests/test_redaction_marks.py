"""Texts without a mark of a secret are not rewritten, and every form of one has a mark."""

import re

from pyspark.sql import functions as F

from briefloom.functions import text


def test_every_secret_has_a_mark(spark):
    bad = ["TOKEN: abc", "my_api-key=xyz1", "bEaReR abcdefgh1", "sk-abcdefgh1", "GHP_" + "a" * 20, "eyJabcd.efgh.ijkl"]
    rows = [(x,) for x in [*bad, "plain words", "a sk b", None, ""]]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(text.redacted(F.col("x"))).collect()]
    assert all("[REDACTED]" in x for x in got[: len(bad)]) and got[len(bad) :] == ["plain words", "a sk b", None, ""]
    assert all(re.search(text.SECRET_MARK, x) for x in bad) and not re.search(text.SECRET_MARK, "plain words")
