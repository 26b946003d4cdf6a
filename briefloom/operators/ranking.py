"""Shortlists, caps and merged windows, each per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.tables import staged

CANDIDATE_CAP, SHORTLIST_CAP = 80, 20


def top(df: DataFrame, limit: int, by: list, order: list, rank: str = "rank") -> DataFrame:
    """The first rows of each group; Spark keeps no more than the limit of each before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= max(0, limit))


def _text() -> Column:
    return F.concat_ws(" ", "title", "summary")


def first_shortlistable(candidates: DataFrame, now: Column, limit: int) -> DataFrame:
    scored = candidates.where(rules.is_shortlistable(_text()))
    scored = scored.withColumn("rough_score", F.round(rules.rough_score(_text(), F.col("source_tier"), F.col("source_weight"), F.col("stars"), F.col("published_at"), now), 6))
    return top(scored, limit, ["run_id"], [F.col("rough_score").desc(), "candidate_id"])


def technical_shortlist(candidates: DataFrame, now: Column, limit: int = SHORTLIST_CAP) -> DataFrame:
    return first_shortlistable(candidates, now, min(limit, SHORTLIST_CAP))


def global_shortlist(candidates: DataFrame, now: Column, limit: int = SHORTLIST_CAP) -> DataFrame:
    age = rules.age_hours(F.col("published_at"), now)
    eligible = candidates.where(F.array_contains("lane_hints", "global") & age.between(0, 168))
    order = [F.when(age <= 48, 0).otherwise(1), "source_tier", F.col("source_weight").desc(), F.col("published_at").desc(), "candidate_id"]
    return top(eligible, min(limit, SHORTLIST_CAP), ["run_id"], order)


def first_newest(candidates: DataFrame, limit: int) -> DataFrame:
    return top(candidates, limit, ["run_id"], [F.col("published_at").desc(), F.col("source_weight").desc(), "candidate_id"])


def newest(candidates: DataFrame, limit: int = CANDIDATE_CAP) -> DataFrame:
    return first_newest(candidates, min(limit, CANDIDATE_CAP))


def merged_fallback(shortlisted: DataFrame, others: DataFrame, limit: int = CANDIDATE_CAP) -> DataFrame:
    """Shortlisted candidates in their order, then the rest by recency."""
    marks = shortlisted.select("run_id", "candidate_id", F.col("rank").alias("first"))
    both = others.join(marks, ["run_id", "candidate_id"], "left")
    order = [F.col("first").asc_nulls_last(), F.col("published_at").desc(), F.col("source_weight").desc(), "candidate_id"]
    return top(both, min(limit, CANDIDATE_CAP), ["run_id"], order, "place").drop("first")


def adaptive_window(candidates: DataFrame, now: Column, narrow: int = 36, wide: int = 168) -> DataFrame:
    """The narrow window's candidates of runs that shortlist any of them; the wide window's of the others."""
    near = candidates.where(rules.in_window(F.col("published_at"), now, narrow))
    enough = technical_shortlist(near, now).select("run_id").distinct().withColumn("enough", F.lit(True))
    within = candidates.where(rules.in_window(F.col("published_at"), now, wide)).join(enough, "run_id", "left")
    return within.where(F.col("enough").isNull() | rules.in_window(F.col("published_at"), now, narrow)).withColumn("expanded", F.col("enough").isNull()).drop("enough")


def heuristic_top(candidates: DataFrame, now: Column, limit: int) -> DataFrame:
    score = F.round(rules.heuristic_score(F.col("source_weight"), F.col("stars"), F.col("published_at"), now), 6)
    return top(candidates.withColumn("score", score), limit, ["run_id"], [F.col("score").desc(), "candidate_id"])


def fitting_places(blocks: DataFrame, budget: int, by: list[str], order: list[str], text: str) -> DataFrame:
    """(by, order, used) of the leading blocks of each group whose bytes, with a line feed after each, fit the budget; order tells a group's blocks apart.

    Prefix sums in two steps over places and sizes alone: all groups are range-sorted together and each range is summed, so a group of any size is spread over many ranges;
    then sizes are added up within the ranges that begin within the budget.  A null text takes nothing, and has no sum where nothing comes before it."""
    keys = [*by, *order]
    sizes = blocks.select(*keys, (F.octet_length(text) + 1).cast("bigint").alias("bytes"))
    sized = staged(sizes.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "sizes")  # written, so that a row keeps its range
    sums = sized.groupBy(*by, "part").agg(F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    begins = sums.select(*by, "part", F.sum("bytes").over(earlier).alias("before")).where(F.col("before").isNull() | (F.col("before") < budget))
    within = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = sized.alias("s").join(begins.hint("merge").alias("b"), F.expr(" AND ".join(f"s.`{c}` <=> b.`{c}`" for c in [*by, "part"])))
    told = met.select(*[F.col(f"s.`{c}`") for c in [*keys, "part", "bytes"]], "before").withColumn("own", F.sum("bytes").over(within))
    used = F.when(F.col("before").isNotNull() | F.col("own").isNotNull(), F.coalesce("before", F.lit(0)) + F.coalesce("own", F.lit(0)))
    return told.select(*keys, used.alias("used")).where(F.col("used") <= budget)


def byte_budget(blocks: DataFrame, budget: int, by: list[str], order: list[str], text: str) -> DataFrame:
    """The blocks of fitting_places(), whole, with what is used up to each; groups and places are not null."""
    return blocks.join(fitting_places(blocks, budget, by, order, text).hint("merge"), [*by, *order])


def external_selection(selection: DataFrame, candidates: DataFrame, limit: int, key: str = "candidate_id") -> DataFrame:
    """Rows of candidates that a list (key, position, importance) names: unknown ones drop out, the first mention
    counts, the cap is by position, the order by importance."""
    named = selection.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where("nth = 1").drop("nth")
    capped = top(named.join(candidates, key), limit, ["run_id"], ["position"], "taken")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("importance").desc(), "position"))).drop("taken")
