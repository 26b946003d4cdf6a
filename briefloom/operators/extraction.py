"""Records from texts by a caller's function, with failures kept apart row by row.

Every candidate is asked about once; those whose answer can't be used are asked again, in a pass of their own, with a smaller excerpt
where the first was too large.  Python only calls the caller's function, one batch of rows after another in many tasks; answers are decoded, checked
and told apart in column expressions, and each pass is written, so no candidate is asked twice because a task was lost later on."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import answers, text
from ..functions.tables import SLICE, small_batches, staged

#: Estimated tokens of a prompt: at first, and after one that was too large.
BUDGETS = (4500, 2200)
#: Characters that are kept of an error.
DETAIL = 300
# What an error says if a prompt was too large.
TOO_LARGE = ("tokens_limit_reached", "payload too large", "request body too large", "maximum context length")
_ANSWER = "id string, answer string, error string, too_large boolean"


class Extraction(NamedTuple):
    """records: id, attempts and the struct r.  audit: id, attempts, reason and detail of candidates without a record."""

    records: DataFrame
    audit: DataFrame


class UnmatchedError(ValueError):
    """Tables whose ids don't go together."""


def matched(candidates: DataFrame, fetched: DataFrame, originals: DataFrame | None = None, key: str = "candidate_id") -> DataFrame:
    """candidates with a struct `source`, the row of fetched with its id, and `original_source_status` from originals (key, status) where there is one.

    Each candidate has one source, each source its candidate, and no candidate two originals; else UnmatchedError names ids that
    are not so (one pass over the ids of all tables, counted in each task first)."""
    sides = [("candidate", candidates), ("source", fetched), *([("original", originals)] if originals is not None else [])]
    ids = None
    for name, side in sides:
        own = side.select(F.col(key).alias("id"), F.lit(name).alias("side"))
        ids = own if ids is None else ids.unionByName(own)
    n = {name: F.count_if(F.col("side") == name) for name in ("candidate", "source", "original")}
    counted = ids.groupBy("id").agg(*[c.alias(name) for name, c in n.items()])
    fault = F.when(F.col("id").isNull(), "no id").when(F.col("candidate") > 1, "repeated candidate").when(F.col("candidate") == 0, "no candidate")
    fault = fault.when(F.col("source") > 1, "repeated source").when(F.col("source") == 0, "no source").when(F.col("original") > 1, "repeated original source")
    faults = counted.withColumn("fault", fault).where(F.col("fault").isNotNull()).orderBy("fault", "id").limit(20).collect()  # to tell, not to mend
    if faults:
        raise UnmatchedError("ids of candidates and sources do not go together: " + ", ".join(f"{r.id} ({r.fault})" for r in faults))
    own = fetched.select(F.col(key), F.struct(*[c for c in fetched.columns if c != key]).alias("source"))
    out = candidates.join(own.hint("merge"), key)
    if originals is None:
        return out.withColumn("original_source_status", F.lit(None).cast("string"))
    return out.join(originals.select(key, F.col("status").alias("original_source_status")).hint("merge"), key, "left")


def _asked(call: Callable[[dict], object]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            rows = []
            for row in batch.to_pylist():
                answer = error = None
                too_large = False
                try:
                    answer = call(row)
                    if answer is not None and not isinstance(answer, str):
                        answer = json.dumps(answer, ensure_ascii=False)
                except Exception as e:  # noqa: BLE001  whatever a caller's function raises is this row's failure
                    said = f"{e} {getattr(e, 'body', '')}".casefold()
                    error, too_large = f"{type(e).__name__}: {e}", getattr(e, "status_code", None) == 413 or any(m in said for m in TOO_LARGE)
                rows.append({"id": row["id"], "answer": answer, "error": error, "too_large": too_large})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("too_large", pa.bool_())]))

    return run


def _judged(answered: DataFrame, kind: StructType, bounds: answers.Bounds, id_field: str, rule: Callable[[Column], Column] | None, attempt: int) -> DataFrame:
    # one step after another, so that an answer is parsed once and not for each of its fields
    read = answered.withColumn("value", F.try_parse_json("answer")).withColumn("path", answers.offence(F.col("value"), kind, bounds))
    read = read.withColumn("r", F.when(F.col("path").isNull(), answers.record(F.col("value"), kind)))
    broken = rule(F.col("r")) if rule else F.lit(None).cast("string")
    reason = (
        F.when(F.col("error").isNotNull(), F.when(F.col("too_large"), "too_large").otherwise("failed"))
        .when(F.col("answer").isNull(), "no_answer")
        .when(F.col("value").isNull(), "not_json")
        .when(F.col("path").isNotNull(), "bad_field")
        .when(~F.col("r")[id_field].eqNullSafe(F.col("id")), "other_id")
        .when(broken.isNotNull(), "broken_rule")
    )
    detail = F.coalesce(F.col("error"), F.when(reason == "bad_field", F.col("path")), F.when(reason == "other_id", F.col("r")[id_field]), broken)
    told = read.withColumns({"reason": reason, "detail": F.when(reason.isNotNull(), text.truncated(text.redacted(text.collapsed(detail)), DETAIL))})
    return told.select("id", F.lit(attempt).alias("attempts"), "reason", "detail", "too_large", F.when(F.col("reason").isNull(), F.col("r")).alias("r"))


def extracted(
    rows: DataFrame,
    call: Callable[[dict], object],
    kind: StructType,
    *,
    key: str = "candidate_id",
    body: str = "text",
    told: tuple[str, ...] = ("title",),
    bounds: answers.Bounds | None = None,
    rule: Callable[[Column], Column] | None = None,
    budgets: tuple[int, int] = BUDGETS,
    attempts: int = 2,
    id_field: str = "candidate_id",
) -> Extraction:
    """What call(row) answers about each row, decoded against kind and its bounds (see functions.answers).

    call gets a dict of id, text (an excerpt of the body within a budget) and the `told` columns, and answers with JSON text or an object of JSON values; null is no answer.
    The record's id_field must be the row's id, and rule(record), if given, must be null.  Ids tell rows apart: see matched().
    reason is too_large, failed, no_answer, not_json, bad_field, other_id or broken_rule; detail the error without secrets, the first offending path, the
    other id or what the rule says."""
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    small_batches(rows.sparkSession)
    own = rows.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(body), F.lit("")).alias("text"), *told)
    frame = F.concat_ws(" ", "id", *told)
    done, due = None, own.withColumn("small", F.lit(False))
    for attempt in range(1, attempts + 1):
        large, small = (text.excerpt(F.col("text"), frame, b) for b in budgets)
        cut = large if attempt == 1 else F.when(F.col("small"), small).otherwise(large)
        answered = staged(due.select("id", cut.alias("text"), *told).mapInArrow(_asked(call), _ANSWER), "answers")
        judged = staged(_judged(answered, kind, bounds or {}, id_field, rule, attempt), "judged")
        failed = judged.where(F.col("reason").isNotNull())
        last = attempt == attempts or failed.isEmpty()
        over = judged if last else judged.where(F.col("reason").isNull())
        done = over if done is None else done.unionByName(over)
        if last:
            break
        due = own.join(failed.select("id", F.col("too_large").alias("small")).hint("merge"), "id")
    records = done.where(F.col("reason").isNull()).select(F.col("id").alias(key), "attempts", "r")
    return Extraction(records, done.where(F.col("reason").isNotNull()).select(F.col("id").alias(key), "attempts", "reason", "detail"))


def refuse_all_failed(found: Extraction, rows: DataFrame, by: str = "run_id", key: str = "candidate_id") -> None:
    """Raises if a run has candidates and a record of none of them; a lane that may be empty leaves this out."""
    made = found.records.select(F.col(key).alias("_id")).withColumn("_made", F.lit(1))
    runs = rows.select(by, F.col(key).cast("string").alias("_id")).join(made.hint("merge"), "_id", "left").groupBy(by).agg(F.count("_made").alias("n"))
    empty = [str(r[0]) for r in runs.where("n = 0").select(by).orderBy(by).limit(20).collect()]
    if empty:
        raise RuntimeError("all extractions failed of runs: " + ", ".join(empty))
