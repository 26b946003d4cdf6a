"""Boards: which scored items of a run are shown, where, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top


def item_order() -> list[Column]:
    return [F.col("total").desc(), F.col("information_gain").desc(), F.col("evidence_quality").desc(), F.col("published").desc(), F.col("fingerprint").asc(), F.col("item").asc()]


def _soon() -> Column:
    return F.coalesce(F.col("action_horizon_days") <= 7, F.lit(False))


def thresholds() -> dict[str, tuple[Column, int, bool]]:
    """Of each board: who may be on it, how many, and whether a company may hold two places at most."""
    main = F.col("eligible_main")
    return {
        "must_read": (main & (F.col("total") >= 75) & (F.col("evidence_quality") >= 12) & (F.col("information_gain") >= 10), 5, True),
        "try_now": (main & (F.col("total") >= 62) & (F.col("actionability") >= 14) & F.col("resource_available") & _soon(), 3, True),
        "watch": (F.col("eligible_watch") & (F.col("total") >= 50), 3, False),
    }


def boards(items: DataFrame) -> DataFrame:
    """items with their board and rank.  A board takes the best eligible item of each event that no earlier board
    has, and within the first two boards at most two of a company; equal events have equal companies."""
    picked = None
    for board, (eligible, limit, capped) in thresholds().items():
        left = items.where(eligible)
        if picked is not None:
            left = left.join(picked.select("run_id", "fingerprint"), ["run_id", "fingerprint"], "left_anti")
        best = top(left, 1, ["run_id", "fingerprint"], item_order(), "of_event")
        if capped:
            used = picked.groupBy("run_id", "company").agg(F.count("*").alias("used")) if picked is not None else None
            best = best.join(used, ["run_id", "company"], "left") if used is not None else best.withColumn("used", F.lit(0))
            place = F.row_number().over(Window.partitionBy("run_id", "company").orderBy(*item_order()))
            best = best.withColumn("of_company", place).where(F.col("of_company") <= 2 - F.coalesce("used", F.lit(0))).drop("used", "of_company")
        chosen = top(best, limit, ["run_id"], item_order()).drop("of_event").withColumn("board", F.lit(board))
        picked = chosen if picked is None else picked.unionByName(chosen)
    return picked


def global_selection(items: DataFrame, limit: int = 5) -> DataFrame:
    """The best global events: 65 points at least, new or materially updated, two of a category at most.
    An event that has several records is taken once."""
    order = [F.col("total").desc(), F.col("time_sensitivity").desc(), F.col("evidence_quality").desc(), F.col("published").desc(), F.col("fingerprint"), F.col("item")]
    fit = items.where((F.col("total") >= 65) & F.col("status").isin("unique", "material_update"))
    once = top(fit, 1, ["run_id", "fingerprint"], order, "of_event")
    few = top(once, 2, ["run_id", "category"], order, "of_category")
    return top(few, max(0, min(limit, 5)), ["run_id"], order).drop("of_event", "of_category")


def without_global(technical: DataFrame, events: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Technical items but those that are global events too and tell nothing to act on."""
    marks = events.select("run_id", key).distinct().withColumn("shown", F.lit(True))
    return technical.join(marks, ["run_id", key], "left").where(F.col("shown").isNull() | F.col("actionable")).drop("shown")
