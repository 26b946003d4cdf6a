"""A whole lane of a briefing as a chain of DataFrame steps, each of which the caller may replace.

All runs go through together: every step is keyed by run_id, so a lane over a year of runs is one job."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions, records, rules
from ..functions.tables import staged
from . import anchors, corroboration, extraction, ranking
from . import boards as board_rules

Step = Callable[[DataFrame], DataFrame]


class Lane(NamedTuple):
    """The steps of a lane: candidates to shortlisted ones; those to records in a struct column `r` (with fetched source columns
    final_url, source_status, original_status); survivors of the first gate to the same with `status`."""

    shortlist: Step
    extract: Step
    classify: Step
    reasons: Callable[[Column, Column], Column] = rules.technical_reasons
    boards: Step = board_rules.boards


def _passed(df: DataFrame, why: Column) -> DataFrame:
    r = F.col("r")
    gated = df.withColumn("why", why)
    return gated.withColumns({"eligible_main": rules.eligible_main(r, F.col("why")), "eligible_watch": rules.eligible_watch(r, F.col("why"))})


def two_passes(rows: DataFrame, classify: Step, reasons: Callable[[Column, Column], Column] = rules.technical_reasons) -> tuple[DataFrame, DataFrame]:
    """(survivors, rejected) of rows with a record `r`.  All are gated as if nothing like them was known; only survivors are
    classified against history, and gated again with what they are found to be.  Both keep `why`; rejected ones of the first pass have no status."""
    first = _passed(rows, reasons(F.col("r"), F.lit("unique")))
    fits = F.col("eligible_main") | F.col("eligible_watch")
    known = classify(first.where(fits).drop("why", "eligible_main", "eligible_watch"))
    second = _passed(known, reasons(F.col("r"), F.col("status")))
    out = first.where(~fits).withColumn("status", F.lit(None).cast("string")).unionByName(second.where(~fits), allowMissingColumns=True)
    return second.where(fits), out.drop("eligible_main", "eligible_watch")


def reading(fetched: DataFrame, call: Callable[[dict], object], is_global: bool = False, originals: DataFrame | None = None, **options: object) -> Step:
    """The extract step of a lane that reads its records from texts: of shortlisted candidates (candidate_id, title, source_tier, ...) and fetched sources
    (candidate_id, final_url, status, text), of which others than the shortlist's are left alone.

    Ids must go together (extraction.matched), call answers for each text (extraction.extracted), and the record is held against its source: anchors that do not stand there go, and
    its kind of source, status and action are the program's, not the answer's.  Every candidate gives a row; `r` is null where there is no record, and `failure` says why."""
    kind, bounds, rule = (records.GLOBAL_KIND, records.GLOBAL_BOUNDS, records.global_rule) if is_global else (records.TECHNICAL_KIND, records.TECHNICAL_BOUNDS, records.technical_rule)

    def extract(shortlisted: DataFrame) -> DataFrame:
        ids = shortlisted.select("candidate_id").distinct()
        own = [None if side is None else side.join(ids.hint("merge"), "candidate_id", "left_semi") for side in (fetched, originals)]
        both = staged(extraction.matched(shortlisted, *own), "matched")
        found = extraction.extracted(both.select("candidate_id", "title", F.col("source.text").alias("text")), call, kind, bounds=bounds, rule=rule, **options)
        told = both.join(found.records.select("candidate_id", "r").hint("merge"), "candidate_id", "left").join(found.audit.select("candidate_id", F.struct("attempts", "reason", "detail").alias("failure")).hint("merge"), "candidate_id", "left")
        r = F.col("r")
        told = staged(told.withColumn("r", records.filled(r, kind)), "told")
        if is_global:
            told = told.withColumn("r", F.when(r.isNotNull(), records.global_provenance(r, F.col("source_tier"), F.col("source.status"))))
        held = staged(anchors.checked(told, claims=not is_global), "held")
        if not is_global:
            action = actions.recommended(r["concrete_changes"], r["affected_audience"], r["affected_area"], r["action_horizon_days"])
            held = held.withColumn("r", F.when(r.isNotNull(), r.withField("recommended_action", action)))
        out = held.withColumns({"final_url": F.col("source.final_url"), "source_status": F.col("source.status"), "original_status": F.col("original_source_status")})
        return out.drop("source", "original_source_status")

    return extract


def scored(candidates: DataFrame, lane: Lane, now: Column) -> tuple[DataFrame, DataFrame]:
    """(scored items that may be on boards, rejected ones) of all runs of candidates (run_id, candidate_id, url, source_tier, published_at, ...).
    A candidate without a record is rejected as evidence_extraction_failed."""
    every = lane.extract(lane.shortlist(candidates))
    found = every.where(F.col("r").isNotNull())
    own = records.with_provenance(F.col("r"), F.col("source_tier"), F.col("url"), F.col("final_url"), F.col("original_status"))
    # written once: every rule below reads many fields of it
    extracted = staged(found.withColumn("r", records.bounded(own, found.schema["r"].dataType)), "records")
    kept, rejected = two_passes(extracted, lane.classify, lane.reasons)
    failed = every.where(F.col("r").isNull()).withColumn("why", F.array(F.lit("evidence_extraction_failed"))).withColumn("status", F.lit(None).cast("string"))
    rejected = rejected.unionByName(failed.withColumn("r", F.lit(None).cast(rejected.schema["r"].dataType)), allowMissingColumns=True)
    valued = kept.withColumn("s", rules.technical_score(F.col("r"), F.col("status"), F.col("published_at"), now))
    items = valued.select("*", "s.*", F.col("r.resource_available").alias("resource_available"), F.col("r.action_horizon_days").alias("action_horizon_days"), F.unix_timestamp("published_at").alias("published"))
    return staged(items, "scored"), rejected


def technical(candidates: DataFrame, lane: Lane, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items on boards, rejected ones) of all runs, as scored() takes them."""
    items, rejected = scored(candidates, lane, now)
    return lane.boards(items.drop("s")), rejected


def technical_audit(items: DataFrame, rejected: DataFrame, shown: DataFrame) -> DataFrame:
    """What became of every candidate that was read: why it was rejected, what it was against history, its score and its board; null where it
    did not come so far.  items and rejected as scored() gives them, shown those on boards."""
    common = ["run_id", "candidate_id", "source_status", "why", "status"]
    r = F.col("r")
    told = [r["source_url"].alias("source_url"), F.transform(r["evidence_anchors"], lambda a: a["locator"]).alias("anchor_locators")]
    seen = items.select(*common, *told, F.col("total").cast("int").alias("total")).unionByName(rejected.select(*common, *told, F.lit(None).cast("int").alias("total")))
    boards = shown.select("run_id", "candidate_id", "board")
    return seen.join(boards.hint("merge"), ["run_id", "candidate_id"], "left").withColumn("selected", F.col("board").isNotNull())


def statistics(audit: DataFrame) -> DataFrame:
    """(run_id, shortlist_count, source_verified_count, rejected_count, top_rejection_reasons) of audit rows (run_id, source_status, selected, why):
    the reasons of those that were not selected, the most frequent first.  Reasons are a fixed list of codes."""
    counts = audit.groupBy("run_id").agg(F.count("*").alias("shortlist_count"), F.count_if(F.col("source_status") == "verified").alias("source_verified_count"), F.count_if(~F.col("selected")).alias("rejected_count"))
    each = audit.where(~F.col("selected")).select("run_id", F.explode("why").alias("reason")).groupBy("run_id", "reason").agg(F.count("*").alias("n"))
    listed = each.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "reason"))).alias("x"))
    reasons = F.map_from_entries(F.transform("x", lambda x: F.struct(x["reason"], -x["order"])))
    named = listed.select("run_id", reasons.alias("top_rejection_reasons"))
    return counts.join(named.hint("merge"), "run_id", "left").withColumn("top_rejection_reasons", F.coalesce("top_rejection_reasons", F.create_map().cast("map<string, bigint>")))


def technical_lane(extract: Step, classify: Step, now: Column) -> Lane:
    return Lane(lambda c: ranking.technical_shortlist(c, now), extract, classify)


class GlobalLane(NamedTuple):
    """The steps of the global lane: candidates to shortlisted ones; those to records in a struct column `r`, null where none could be
    made, with fingerprint and source_status; records to the same with `status` against history."""

    shortlist: Step
    extract: Step
    classify: Step
    select: Step = board_rules.global_selection


def global_events(candidates: DataFrame, lane: GlobalLane, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with supporting_urls, audit, stats by run) of all runs of candidates (run_id, candidate_id, published_at, ...).

    Every record is held against how many hosts of its run tell of its event; audit has a row for each shortlisted candidate."""
    short = staged(lane.shortlist(candidates), "shortlist")
    found = staged(lane.extract(short), "events")
    r = F.col("r")
    made = found.where(r.isNotNull())
    by = ["run_id", "fingerprint"]
    reports = made.select(*by, "candidate_id", *[r[x].alias(x) for x in ("source_url", "source_type", "verification_status")])
    hosts = corroboration.secondary_hosts(reports, by).select(*by, "n_reports", "secondary_hosts")
    age = (F.unix_micros(now) - F.unix_micros("published_at")) / 3.6e9
    known = lane.classify(made).join(hosts.hint("merge"), by).withColumn("age", age)
    why = rules.global_reasons(r, F.col("secondary_hosts"), F.col("status"), F.col("age"))
    scored = known.withColumn("why", why).withColumn("s", rules.global_score(r, F.col("secondary_hosts"), F.col("status"), F.col("age")))
    gated = staged(scored.select("*", F.col("s.total").alias("total"), F.col("s.recency").alias("time_sensitivity"), F.col("s.evidence_quality").alias("evidence_quality"), F.unix_timestamp("published_at").alias("published")), "gated")
    others = corroboration.supporting_urls(reports, by).select("run_id", "candidate_id", "supporting_urls")
    events = staged(lane.select(gated.where(F.size("why") == 0)).join(others.hint("merge"), ["run_id", "candidate_id"]), "chosen")

    seen = gated.select("run_id", "candidate_id", "source_status", "n_reports", "why", "status", F.when(F.size("why") == 0, F.col("total")).alias("total"))
    none = {"n_reports": "bigint", "status": "string", "total": "int"}
    failed = found.where(r.isNull()).select("run_id", "candidate_id", "source_status", F.array(F.lit("global_extraction_failed")).alias("why"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    marks = events.select("run_id", "candidate_id", F.lit(True).alias("selected"))
    audit = seen.unionByName(failed).withColumn("n_reports", F.coalesce("n_reports", F.lit(0))).join(marks.hint("merge"), ["run_id", "candidate_id"], "left").na.fill(False, ["selected"])
    counts = audit.groupBy("run_id").agg(F.count("*").alias("shortlist_count"), F.count_if(F.col("source_status") == "verified").alias("source_verified_count"), F.count_if(~F.col("selected")).alias("rejected_count"))
    told = events.groupBy("run_id").agg(F.bool_or((F.col("age") > 48) & (F.col("age") <= 168)).alias("fallback_used"))
    every = candidates.groupBy("run_id").agg(F.count("*").alias("candidate_count"))
    stats = every.join(counts, "run_id", "left").join(told, "run_id", "left").na.fill(0).na.fill(False, ["fallback_used"])
    return events, audit, stats
