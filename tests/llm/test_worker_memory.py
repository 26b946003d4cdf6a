"""What an operator leaves in a worker that the next one, or none, uses."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from briefloom.llm import neardup, quality, secrets, textscan


@pytest.mark.parametrize("column", [lambda t: neardup.signatures(t, 5, 64), lambda t: neardup.full_sets(t, 5), quality.features, secrets.redacted, secrets.found_secrets])
def test_a_batch_gives_its_memory_back(spark, monkeypatch, column):
    made, trimmed = [], []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: lambda *columns: made.append(f) or F.lit(0))
    monkeypatch.setattr(textscan, "trim", lambda: trimmed.append(1))
    column(F.col("text"))
    made[0](pa.array(["a b c d e f g", None, ""]))
    before = len(trimmed)
    assert before >= 1
    with pytest.raises((AttributeError, TypeError)):
        made[0](None)
    assert len(trimmed) > before


def test_release_gives_back_what_is_free_also_where_nothing_was_held(monkeypatch):
    trimmed = []
    monkeypatch.setattr(textscan, "trim", lambda: trimmed.append(1))
    monkeypatch.setattr(textscan, "_held", {})
    textscan.release()
    assert trimmed == [1]
