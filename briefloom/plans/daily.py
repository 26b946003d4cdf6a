"""The daily run: from landed feeds and pages to briefings that keep their contract, to deliveries and what is remembered of them.

All editions (run_id) of a run go through together.  What a run makes lies in folders of its own under one home, `<table>/run=<identifier>`, and is
written in this order: told, audit, digests; then, once sent, ledger, urls, events.  A run that ended anywhere is repeated under the same
identifier: before its first entry in the ledger it makes its tables anew, and after that it keeps them, sends what the ledger does
not have, and writes the histories of all that was sent.  A run reads the histories of other runs only, so a repeated one sees what it saw before."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, rules, text, urls
from ..functions.tables import staged
from ..operators import boards, compose, contracts, dedupe, history, lanes, ranking
from ..sources import landed

#: Hours of a run's candidates, and of the wider window of an edition that shortlists nothing in them.
HOURS, WIDE_HOURS = 36, 168
# Categories of items that stay on boards beside a global event of the same candidate.
ACTIONABLE = ("ai_coding", "agents", "image_video", "comfyui", "open_source", "mcp", "skills")
#: Why an item of a board is not told: a global event tells it.
TOLD_GLOBALLY = "told_as_global_event"

_LEDGER = "day date, target string, sent_at timestamp, run_status string, run string"
_URLS = "run_id string, url string, recorded_at timestamp, run string"
_EVENTS = (
    "run_id string, fingerprint string, lane string, recorded_at timestamp, entities array<string>, primary_entity string, product_or_model string, change_signature string, version_or_metric string, "
    "effective_date string, resource_available boolean, scientific_verified boolean, source_type string, geographic_scope array<string>, source_url string, run string"
)

Call = Callable[[dict], object]


class Inputs(NamedTuple):
    """What a run reads.  candidates: run_id, candidate_id (its own in every edition), title, summary, url, source, source_tier, source_weight, stars, published_at, lane_hints.
    pages: what fetches came to: url, final_url, code, content_type, html, fetched_at.  Calls answer for texts as in extraction.extracted."""

    candidates: DataFrame
    pages: DataFrame
    technical: Call
    world: Call


class Briefing(NamedTuple):
    """documents: run_id, payload, run_status, version, violations, good.  audit: a row for each candidate that a lane read.  told: what the
    documents tell, as rows that histories are made of."""

    documents: DataFrame
    audit: DataFrame
    told: DataFrame


def collected(spark: SparkSession, feeds: str, sources: DataFrame, editions: DataFrame, now: Column, searches: str | None = None) -> DataFrame:
    """Candidates of all editions (run_id, source, lane_hints) from feed files (a folder for each source) and search results (a candidate of every edition), in the wide window.
    A page that several sources of an edition tell of is one candidate, that of the best of them.  If no source has a feed that can be read, reading fails."""
    entries = landed.feed_candidates(spark, f"{feeds}/*", sources, now, WIDE_HOURS).drop("pos", "ai_only")
    read = landed.feed_sources(spark, f"{feeds}/*").withColumn("ok", F.lit(True))
    outcomes = sources.select("source").join(read.hint("merge"), "source", "left").select(F.col("source").alias("collector"), F.coalesce("ok", F.lit(False)).alias("ok"))
    landed.collection_health(outcomes).collect()  # one row
    both = entries.select("source", "title", "summary", "url", "source_tier", "source_weight", "published_at", F.lit(0).cast("bigint").alias("stars")).join(editions, "source")
    if searches is not None:
        found = landed.repository_candidates(spark, searches).where("published_at is not null")
        found = found.select(F.lit("repositories").alias("source"), "title", "summary", "url", "source_tier", "source_weight", "published_at", F.element_at("metrics", "stars").cast("bigint").alias("stars"))
        names = editions.select("run_id").distinct().withColumn("lane_hints", F.array(F.lit("technical")))
        both = both.unionByName(found.join(names.withColumn("source", F.lit("repositories")).hint("merge"), "source"))
    own = both.withColumn("candidate_id", F.concat_ws("-", "run_id", urls.stable_id(F.col("url"))))
    order = ["source_tier", F.col("source_weight").desc(), F.col("stars").desc(), F.col("published_at").desc(), "source", "title", "summary", "url"]
    return ranking.top(own, 1, ["run_id", "candidate_id"], order).drop("rank")


def prepared(candidates: DataFrame, sent: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates that a run looks at, the editions (run_id) whose narrow window suffices).

    What an edition sent within 30 days goes, like titles go, and the newest stay.  An edition that would shortlist none of these takes the wider window: its
    shortlisted ones first, then the newest."""
    new = staged(history.unsent(candidates, sent, now, ("run_id",)).where(rules.in_window(F.col("published_at"), now, WIDE_HOURS)), "new")
    # only the first of what hard dedupe keeps are looked at, so no more is settled than these depend on
    newest, shortlisted = (ranking.CANDIDATE_CAP, ranking.first_newest), (ranking.SHORTLIST_CAP, lambda c, n: ranking.first_shortlistable(c, now, n))
    near = staged(ranking.newest(dedupe.first_kept(new.where(rules.in_window(F.col("published_at"), now, HOURS)), newest)), "near")
    enough = staged(ranking.technical_shortlist(near, now).select("run_id").distinct(), "enough")
    few = staged(new.join(enough, "run_id", "left_anti"), "few")
    wide = dedupe.first_kept(few, shortlisted, newest)
    merged = ranking.merged_fallback(ranking.technical_shortlist(wide, now), wide)
    stay = near.join(enough, "run_id", "left_semi")
    return staged(stay.drop("rank").unionByName(merged.drop("place")), "prepared"), enough


def fetched(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(candidate_id, final_url, status, text) of every candidate: the last fetch of its page, unavailable where there was none."""
    keyed = pages.select(urls.canonical_url(F.col("url")).alias("page"), "final_url", "code", "content_type", "html", "fetched_at")
    asked = candidates.select("candidate_id", urls.canonical_url(F.col("url")).alias("page"))
    # of the pages only those that are asked for are kept and parsed
    last = keyed.join(asked.select("page").distinct().hint("merge"), "page", "left_semi").groupBy("page").agg(F.max_by(F.struct("final_url", "code", "content_type", "html"), F.struct("fetched_at", "final_url")).alias("x"))
    read = last.select("page", "x.*").withColumn("p", text.page_content(F.col("html")))
    status = F.coalesce(text.fetch_status(F.col("code"), F.coalesce("content_type", F.lit("")), F.col("p.status")), F.lit("unavailable"))
    told = read.select("page", "final_url", status.alias("status"), F.when(status.isin("verified", "insufficient"), F.col("p.text")).otherwise("").alias("text"))
    both = asked.join(told.hint("merge"), "page", "left")
    return both.select("candidate_id", F.coalesce("final_url", "page").alias("final_url"), F.coalesce("status", F.lit("unavailable")).alias("status"), F.coalesce("text", F.lit("")).alias("text"))


def _texts(r: Column, product: str) -> dict[str, Column]:
    """What a record is known by in history."""
    named = {"primary_entity": r["primary_entity"], "product_or_model": r[product], "change_signature": r["change_signature"], "version_or_metric": r["version_or_metric"], "effective_date": r["effective_date"]}
    return {k: F.coalesce(v, F.lit("")) for k, v in named.items()}


def _entries(rows: DataFrame, lane: str) -> DataFrame:
    """Rows with a record `r` as the rows that history.snapshots() takes."""
    r = F.col("r")
    own = {"event_entities": r["event_entities"], "source_url": r["source_url"], "source_type": r["source_type"]}
    if lane == "technical":
        own |= {"resource_available": r["resource_available"], "scientific_verified": r["original_paper_or_independent_validation"], "geographic_scope": F.array().cast("array<string>")}
    else:
        own |= {"resource_available": F.lit(False), "scientific_verified": r["scientific_verified"], "geographic_scope": r["geographic_scope"]}
    named = _texts(r, "product_or_model" if lane == "technical" else "product_or_policy") | own
    return rows.select("run_id", "candidate_id", "fingerprint", F.lit(lane).alias("lane"), *[v.alias(k) for k, v in named.items()])


def _known(past: DataFrame, lane: str, now: Column) -> lanes.Step:
    """The classify step of a lane; every edition has a history of its own."""
    keyed = F.concat_ws("/", "run_id", "lane")
    old = past.where(F.col("lane") == lane).withColumn("lane", keyed).withColumn("event_id", F.xxhash64("run", "source_url"))
    compare = history.classified if lane == "technical" else history.classified_global

    def classify(rows: DataFrame) -> DataFrame:
        new = staged(history.snapshots(_entries(rows, lane), lane, now, ("run_id", "candidate_id")).withColumn("lane", keyed), "snapshots")
        told = compare(new, old, now, "candidate_id").select("candidate_id", F.col("dup_status").alias("status"), "update_of")
        return rows.join(told.hint("merge"), "candidate_id")

    return classify


def _named(read: lanes.Step, product: str) -> lanes.Step:
    r = F.col("r")

    def extract(shortlisted: DataFrame) -> DataFrame:
        # `source` is the fetched page while a lane reads
        made = read(shortlisted.withColumnRenamed("source", "source_label")).withColumnRenamed("source_label", "source")
        mark = text.fingerprint(*_texts(r, product).values())
        return staged(made.withColumns({"fingerprint": mark, "company": text.company_key(r["primary_entity"]), "category": r["category"], "item": F.col("candidate_id")}), "named")

    return extract


def _rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _item(board: Column) -> Column:
    r = F.col("r")
    acts = F.when(F.coalesce(r["recommended_action"], F.lit("")) != "", F.array(r["recommended_action"])).otherwise(F.array().cast("array<string>"))
    c = F.struct("candidate_id", "title", "summary", "source", "published_at")
    made = records.draft(c, r.withField("recommended_action", acts), F.col("fingerprint"), F.col("update_of"), F.col("s"))
    return made.withField("board", board).withField("published_at", _rfc3339(F.col("published_at")))


def _event() -> Column:
    r = F.col("r")
    same = "category title_zh what_happened_zh why_it_matters_zh affected_groups_zh key_facts source_url primary_entity product_or_policy change_signature version_or_metric effective_date event_entities".split()
    return F.struct(
        F.col("fingerprint").alias("event_id"), "candidate_id", records.safe(F.col("source"), 120).alias("source_name"), *[r[x].alias(x) for x in same], "supporting_urls",
        _rfc3339(F.col("published_at")).alias("published_at"), F.col("s").alias("score"),
    )


def briefing(inputs: Inputs, editions: DataFrame, sent: DataFrame, past: DataFrame, now: Column) -> Briefing:
    """The briefing of every edition (run_id, ...), also of one that has no candidates.  sent: run_id, url, recorded_at; past: entries of history with run_id.

    An item of a global event's candidate that has nothing to act on is not on a board, and neither is one of the same fingerprint as a global event, which the
    contract forbids; both count as rejected."""
    kept, enough = prepared(inputs.candidates, sent, now)
    pages = staged(fetched(kept, inputs.pages), "fetched")
    short = {"technical": staged(ranking.technical_shortlist(kept, now), "technical"), "global": staged(ranking.global_shortlist(kept, now), "global")}
    lane = lanes.Lane(lambda c: short["technical"], _named(lanes.reading(pages, inputs.technical), "product_or_model"), _known(past, "technical", now))
    items, rejected = lanes.scored(kept, lane, now)
    rejected = staged(rejected, "rejected")
    shown = staged(lane.boards(items), "shown")
    world = lanes.GlobalLane(lambda c: short["global"], _named(lanes.reading(pages, inputs.world, is_global=True), "product_or_policy"), _known(past, "global", now))
    events, global_audit, global_stats = lanes.global_events(kept, world, now)

    names = editions.select("run_id").distinct()
    counts = kept.groupBy("run_id").agg(F.count("*").alias("candidate_count"), F.countDistinct("source").alias("source_count"))
    runs = names.join(counts, "run_id", "left").join(enough.withColumn("fallback_used", F.lit(False)), "run_id", "left").na.fill(0, ["candidate_count", "source_count"]).na.fill(True, ["fallback_used"])
    runs = staged(runs.withColumn("global_candidate_count", F.col("candidate_count")).withColumn("lookback_hours", F.when(F.col("fallback_used"), WIDE_HOURS).otherwise(HOURS)), "runs")
    acts = F.col("r.resource_available") & (F.coalesce("r.recommended_action", F.lit("")) != "") & F.col("r.category").isin(*ACTIONABLE)
    told_events = events.select("run_id", "rank", "candidate_id", F.col("r.title_zh").alias("title"), F.col("r.affected_groups_zh").alias("groups"), "published_at")
    apart = shown.join(events.select("run_id", "fingerprint").hint("merge"), ["run_id", "fingerprint"], "left_anti")
    heads, left = compose.daily(runs, apart.withColumn("actionable", F.coalesce(acts, F.lit(False))), told_events, now)
    left = staged(left, "left")

    audit = lanes.technical_audit(items, rejected, shown)
    here = left.select("run_id", "candidate_id", F.lit(True).alias("here"))
    moved = F.col("selected") & F.col("here").isNull()
    audit = audit.join(here.hint("merge"), ["run_id", "candidate_id"], "left")
    audit = audit.withColumns({"why": F.when(moved, F.array(F.lit(TOLD_GLOBALLY))).otherwise(F.col("why")), "selected": F.col("selected") & ~moved, "board": F.when(~moved, F.col("board"))}).drop("here")
    audit = staged(audit, "audit")
    stats = _stats(runs, lanes.statistics(audit)).withColumnRenamed("stats", "pipeline_stats")
    world_stats = _stats(runs, lanes.statistics(global_audit)).withColumnRenamed("stats", "global_pipeline_stats")

    order = F.array_position(F.array(*map(F.lit, compose.BOARD_LIMITS)), F.col("board"))
    listed = left.select("run_id", order.alias("place"), "rank", _item(F.col("board")).alias("x")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "rank", "x"))).alias("items"))
    first = events.select("run_id", "rank", _event().alias("x")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("events"))
    all_of = heads.select("*", F.col("narrative").alias("daily_narrative_zh"))
    for part in (listed, first, stats, world_stats):
        all_of = all_of.join(part.hint("merge"), "run_id", "left")
    all_of = staged(all_of, "parts")
    of = lambda k: F.coalesce(F.transform(F.filter("items", lambda e: e["place"] == k), lambda e: e["x"]), F.array().cast(_list_type(all_of, "items")))
    on = {b: of(k) for k, b in enumerate(compose.BOARD_LIMITS, 1)}
    digest = F.struct(
        F.lit(4).alias("schema_version"), "run_status", _rfc3339(now).alias("generated_at"), "candidate_count", "source_count", _rfc3339(F.col("latest_published_at")).alias("latest_published_at"), "fresh_count_24h",
        "lookback_hours", "fallback_used", F.struct(*[v.alias(b) for b, v in on.items()]).alias("boards"), F.concat(*on.values()).alias("items"), "pipeline_stats", records.safe(F.col("daily_narrative_zh"), contracts.NARRATIVE).alias("daily_narrative_zh"),
        F.coalesce(F.transform("events", lambda e: e["x"]), F.array().cast(_list_type(all_of, "events"))).alias("global_events"), "global_pipeline_stats",
    )
    documents = contracts.checked(all_of.select("run_id", "run_status", F.to_json(digest, {"ignoreNullFields": "false"}).alias("payload")))

    both = audit.select("run_id", F.lit("technical").alias("lane"), "candidate_id", "source_status", "why", "status", "total", "selected", "board").unionByName(
        global_audit.select("run_id", F.lit("global").alias("lane"), "candidate_id", "source_status", "why", "status", F.col("total").cast("int").alias("total"), "selected", F.lit(None).cast("string").alias("board"))
    )
    return Briefing(documents, both, _entries(left, "technical").unionByName(_entries(events, "global")))


def _list_type(df: DataFrame, name: str) -> str:
    """The type of a list of the entries' `x`."""
    return f"array<{df.schema[name].dataType.elementType['x'].dataType.simpleString()}>"


def _stats(runs: DataFrame, counted: DataFrame) -> DataFrame:
    names = ("shortlist_count", "source_verified_count", "rejected_count")
    both = runs.select("run_id", "candidate_count").join(counted.hint("merge"), "run_id", "left")
    reasons = F.coalesce("top_rejection_reasons", F.create_map().cast("map<string, bigint>"))
    return both.select("run_id", F.struct("candidate_count", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], reasons.alias("top_rejection_reasons")).alias("stats"))


def _stored(spark: SparkSession, home: str, name: str, kind: str) -> DataFrame:
    """A table of all runs; empty before the first."""
    try:
        return spark.read.schema(kind).parquet(f"{home}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def delivered(spark: SparkSession, home: str) -> DataFrame:
    """The ledger of all runs: day, target, sent_at, run_status, run."""
    return _stored(spark, home, "ledger", _LEDGER)


def generate(spark: SparkSession, home: str, run: str, inputs: Inputs, editions: DataFrame, now: Column) -> None:
    """Writes what the run tells, its audit and its documents, these last, in place of what an earlier attempt left."""
    others = [_stored(spark, home, name, kind).where(F.col("run") != run) for name, kind in (("urls", _URLS), ("events", _EVENTS))]
    made = briefing(inputs, editions, *others, now)
    for name, table in (("told", made.told), ("audit", made.audit), ("digests", made.documents)):
        table.write.mode("overwrite").parquet(f"{home}/{name}/run={run}")


def deliver(spark: SparkSession, home: str, run: str, send: Callable[[DataFrame], None], now: Column) -> None:
    """Sends the run's good documents (run_id, run_status, payload) that their day has not had; then the ledger gets them, and last the histories.

    The ledger only grows.  Histories are those of all that the ledger has of this run, so an attempt that ended after the ledger is made up for.  What was sent
    but not entered is sent again, since only the ledger tells.  Documents that break the contract are not sent and stay as they are, to be looked at."""
    good = spark.read.parquet(f"{home}/digests/run={run}").where("good")
    ledger = delivered(spark, home)
    attempts = good.select(history.local_day(now).alias("day"), F.col("run_id").alias("target"), "run_status", "payload")
    due = staged(history.undelivered(attempts, ledger), "due")
    if not due.isEmpty():
        send(due.select(F.col("target").alias("run_id"), "run_status", "payload"))
        due.select("day", "target", now.alias("sent_at"), "run_status").write.mode("append").parquet(f"{home}/ledger/run={run}")
    entered = delivered(spark, home).where(F.col("run") == run).groupBy(F.col("target").alias("run_id")).agg(F.max("sent_at").alias("recorded_at"))
    told = staged(spark.read.parquet(f"{home}/told/run={run}").join(entered.hint("merge"), "run_id"), "told")
    told.select("run_id", F.col("source_url").alias("url"), "recorded_at").distinct().write.mode("overwrite").parquet(f"{home}/urls/run={run}")
    shots = [history.snapshots(told.where(F.col("lane") == lane), lane, F.col("recorded_at"), ("run_id",)) for lane in ("technical", "global")]
    shots[0].unionByName(shots[1]).write.mode("overwrite").parquet(f"{home}/events/run={run}")


def daily_run(spark: SparkSession, home: str, run: str, inputs: Inputs, editions: DataFrame, now: Column, send: Callable[[DataFrame], None]) -> None:
    """One run, whole or what is left of it.  run: its identifier, a name for a folder, the same whenever the run is repeated."""
    if delivered(spark, home).where(F.col("run") == run).isEmpty():
        generate(spark, home, run, inputs, editions, now)
    deliver(spark, home, run, send, now)
