"""Answers against schemas, matched tables, and extraction by functions that fail."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from briefloom.functions import answers
from briefloom.operators import extraction

FACT = StructType([StructField("name", StringType(), False), StructField("value", DoubleType(), True)])
KIND = StructType(
    [
        StructField("candidate_id", StringType(), False), StructField("title", StringType(), False), StructField("kind", StringType(), True), StructField("n", IntegerType(), True),
        StructField("sure", BooleanType(), True), StructField("facts", ArrayType(FACT, False), True), StructField("tags", ArrayType(StringType(), False), True),
    ]
)
BOUNDS = {"$.title": (2, 10), "$.kind": ("a", "b"), "$.n": (0, 9), "$.facts": (0, 2), "$.facts[].name": (1, 5)}


@pytest.mark.parametrize(
    ("answer", "path"),
    [
        ({}, None), ({"extra": [1]}, None), ({"kind": None, "n": None, "facts": None, "tags": []}, None), ({"facts": [{"name": "x", "value": 1}, {"name": "y", "value": 1.5}], "tags": ["t"], "sure": True, "n": 9, "kind": "b"}, None),
        ({"title": None}, "$.title"), ({"title": 5}, "$.title"), ({"title": "x"}, "$.title"), ({"title": "x" * 11}, "$.title"), ({"kind": "c"}, "$.kind"), ({"n": 1.5}, "$.n"), ({"n": "1"}, "$.n"), ({"n": 10}, "$.n"),
        ({"sure": "yes"}, "$.sure"), ({"facts": {}}, "$.facts"), ({"facts": [{"name": "x"}] * 3}, "$.facts"), ({"facts": [{"name": "x"}, {"value": 1}]}, "$.facts[1].name"), ({"facts": [{"name": "toolong"}]}, "$.facts[0].name"),
        ({"facts": [None]}, "$.facts[0]"), ({"facts": [3]}, "$.facts[0]"), ({"facts": [{"name": "x", "value": "1"}]}, "$.facts[0].value"), ({"tags": ["a", None]}, "$.tags[1]"), ({"tags": ["a", "b", 1]}, "$.tags[2]"), ({"n": "x", "tags": "y"}, "$.n"),
    ],
)
def test_first_offending_path(spark, answer, path):
    whole = json.dumps({"candidate_id": "1", "title": "Title"} | answer)
    value = F.try_parse_json(F.col("a"))
    got = spark.createDataFrame([(whole,)], "a string").select(answers.offence(value, KIND, BOUNDS).alias("p"), answers.record(value, KIND).alias("r")).first()
    assert got.p == path
    if path is None and answer.get("facts"):
        assert got.r.facts[1].value == 1.5 and got.r.tags == ["t"]


def test_no_object(spark):
    df = spark.createDataFrame([("[1]",), ("3",), ("{",), (None,), ("null",), ("",)], "a string")
    value = F.try_parse_json(F.col("a"))
    got = df.select(value.isNotNull().alias("j"), answers.offence(value, KIND).alias("p")).collect()
    assert [(r.j, r.p) for r in got] == [(True, "$"), (True, "$"), (False, "$"), (False, "$"), (True, "$"), (False, "$")]


def test_tables_that_do_not_go_together(spark):
    made = lambda ids, more="": spark.createDataFrame([(i, "verified", "x") for i in ids], "candidate_id string, status string, text string")
    good = extraction.matched(made("ab").select("candidate_id"), made("ba"), made("a").select("candidate_id", F.lit("blocked").alias("status")))
    assert sorted((r.candidate_id, r.source.status, r.original_source_status) for r in good.collect()) == [("a", "verified", "blocked"), ("b", "verified", None)]
    assert extraction.matched(made(""), made("")).collect() == []
    for left, right, original, told in (("aab", "ab", "", "a (repeated candidate)"), ("a", "ab", "", "b (no candidate)"), ("ab", "a", "", "b (no source)"), ("ab", "abb", "", "b (repeated source)"), ("ab", "ab", "aa", "a (repeated original"), ("ab", "ab", "c", "c (no candidate)"), ([None], [None], "", "(no id)")):
        with pytest.raises(extraction.UnmatchedError, match=told.replace("(", r"\(").replace(")", r"\)")):
            extraction.matched(made(left), made(right), made(original))


def answering(tmp_path):
    """Answers by what the text says, and writes down each call."""

    def call(row):
        with open(tmp_path / f"{row['id']}.calls", "a") as f:
            f.write(f"{len(row['text'])}\n")
        calls = len((tmp_path / f"{row['id']}.calls").read_text().split())
        kind = row["text"].split(" ")[0]
        good = {"candidate_id": row["id"], "title": row["title"]}
        if kind == "crash" or kind == "once" and calls == 1:
            raise ValueError("broken, token=abcdefghijkl")
        if kind == "large" and len(row["text"]) > 300:
            raise RuntimeError("Payload Too Large")
        return {"text": json.dumps(good), "none": None, "bad": "{", "field": good | {"n": "x"}, "other": good | {"candidate_id": "zz"}, "slash": good | {"title": "a/b"}}.get(kind, good)

    return call


def test_failures_stay_with_their_rows(spark, tmp_path):
    texts = ["text", "crash", "once", "large " + "word " * 200, "none", "bad", "field", "other", "slash", "huge " + "word " * 5000, None]
    rows = spark.createDataFrame([(f"c{i}", f"run{i % 2}", "Title", t, 1) for i, t in enumerate(texts)], "candidate_id string, run_id string, title string, text string, r int").repartition(3)
    rule = lambda r: F.when(r["title"].contains("/"), "title of a repository")
    found = extraction.extracted(rows, answering(tmp_path), KIND, bounds=BOUNDS, rule=rule, budgets=(300, 60))
    assert {r.candidate_id: (r.attempts, r.r.title) for r in found.records.collect()} == {"c0": (1, "Title"), "c2": (2, "Title"), "c3": (2, "Title"), "c9": (1, "Title"), "c10": (1, "Title")}
    assert {r.candidate_id: (r.attempts, r.reason, r.detail) for r in found.audit.collect()} == {
        "c1": (2, "failed", "ValueError: broken, token=[REDACTED]"), "c4": (2, "no_answer", None), "c5": (2, "not_json", None), "c6": (2, "bad_field", "$.n"), "c7": (2, "other_id", "zz"), "c8": (2, "broken_rule", "title of a repository"),
    }
    calls = {p.stem: [int(x) for x in p.read_text().split()] for p in tmp_path.glob("*.calls")}
    assert {k: len(v) for k, v in calls.items()} == {f"c{i}": 1 if i in (0, 9, 10) else 2 for i in range(11)}
    assert calls["c3"][0] > 300 >= calls["c3"][1] and calls["c1"][0] == calls["c1"][1] and calls["c9"][0] < 1000
    extraction.refuse_all_failed(found, rows)
    alone = rows.where("candidate_id IN ('c1', 'c4')")
    with pytest.raises(RuntimeError, match="run0, run1"):
        extraction.refuse_all_failed(extraction.extracted(alone, answering(tmp_path), KIND), alone)
    none = extraction.extracted(rows.where("false"), answering(tmp_path), KIND)
    assert none.records.collect() == [] and none.audit.collect() == []
