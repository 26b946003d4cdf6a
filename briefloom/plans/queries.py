"""Queries over the given tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import actions, evidence, records, rules, text, urls
from ..functions.tables import new_folder
from ..operators import anchors, boards, cards, compose, contracts, corroboration, dedupe, extraction, history, lanes, ranking
from ..sources import adapters
from ..sources.adapters import candidates, clusters, event_records, now, scored_items, table
from ..streaming import memory, state
from . import daily


def w2_technical_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return ranking.technical_shortlist(candidates(spark, d), now()).select("run_id", "candidate_id", "rank", "rough_score")


def w3_global_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return ranking.global_shortlist(candidates(spark, d), now()).select("run_id", "candidate_id", "rank", "source_tier", "source_weight")


def w1_candidate_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.newest(candidates(spark, d)).select("run_id", "candidate_id", "rank")


def w9_fallback_merge(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return ranking.merged_fallback(ranking.technical_shortlist(c, now()), c).select("run_id", "candidate_id", "place")


def w10_adaptive_window(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.adaptive_window(candidates(spark, d), now(), narrow=3)
    return out.groupBy("run_id", "expanded").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))


def w11_heuristic_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.heuristic_top(candidates(spark, d), now(), 10).select("run_id", "candidate_id", "rank", "score")


def f1_ai_window(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).where(rules.in_window(F.col("published_at"), now(), 36))
    return c.where(rules.looks_ai(F.col("title"), F.col("summary"))).select("candidate_id", "run_id")


def f4_specific(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws(" ", "title", "summary")
    return candidates(spark, d).groupBy("run_id").agg(F.count_if(rules.is_specific(body)).alias("n_specific"), F.count_if(rules.is_shortlistable(body)).alias("n_shortlistable"), F.count("*").alias("n"))


def f12_dashboard_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    haystack = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    extra = F.array(F.concat(F.lit("Brand#"), (F.col("p_partkey") % 5 + 1).cast("string")))
    fits = (F.col("p_brand") == "Brand#1") | F.array_contains(extra, "Brand#1")
    return p.where(fits & haystack.contains("1")).select("p_partkey", "p_brand", "p_size")


def t3_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.canonical_url(u).alias("canonical"), urls.stable_id(u).alias("stable_id"), urls.host(u).alias("host"))


def t6_truncate(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.truncated(x, 120).alias("short"), text.estimated_tokens(x).alias("tokens"), text.is_chinese(x).alias("chinese"))


def t10_redaction(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("safe"), "text")
    return out.where(F.col("safe") != F.col("text")).select("doc_id", F.sha2("safe", 256).alias("safe_sha256"), F.char_length("safe").cast("bigint").alias("n"))


def t11_url_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.redacted_url(F.col("url")).alias("safe_url"))


def f8_f9_checks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    day = F.concat(F.lit("2026-"), F.lpad((F.col("page_id") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("page_id") % 33).cast("string"), 2, "0"))
    return pages.select("page_id", urls.is_evidence_url(F.col("url")).alias("good_url"), text.is_calendar_date(day).alias("good_date"))


def t5_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    t = F.col("title")
    return c.select("candidate_id", text.normal_title(t).alias("title"), text.slug(t).alias("slug"), text.company_key(t).alias("company"))


def t1_clean_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.cleaned_html(F.col("html")).alias("line"))


def t2_page_content(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "pages").select("page_id", text.page_content(F.col("html")).alias("c"))
    return out.select("page_id", "c.title", "c.status", "c.truncated", F.char_length("c.text").cast("bigint").alias("n_chars"))


def _url_history(spark: SparkSession, d: str) -> DataFrame:
    """Every page was met at one time or another; by their age, some were sent within the days that count."""
    pages = table(spark, d, "pages")
    return pages.select("url", (now() - F.make_dt_interval(days=(F.col("page_id") % 45).cast("int"))).alias("recorded_at"))


def j1_unsent(spark: SparkSession, d: str) -> DataFrame:
    return history.unsent(table(spark, d, "pages").select("page_id", "url"), _url_history(spark, d), now()).select("page_id")


def k4_url_history(spark: SparkSession, d: str) -> DataFrame:
    seen = _url_history(spark, d)
    new = history.unsent(seen, seen, now()).select("url", now().alias("recorded_at"))  # pages that are due again are sent now
    out = history.url_history(_url_history(spark, d), new, now())
    return out.select("url", F.unix_timestamp("recorded_at").alias("recorded"))


def _event_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = event_records(spark, d)
    day = F.lit(adapters.EVENT_DAY).cast("timestamp")
    return e.where((F.col("recorded_at") >= day) & (F.col("recorded_at") < day + F.expr("INTERVAL 1 DAY"))), e.where(F.col("recorded_at") < day)


def _event_now():
    return F.lit(adapters.EVENT_DAY + " 23:59:59").cast("timestamp")


def j6_event_classification(spark: SparkSession, d: str) -> DataFrame:
    current, past = _event_sides(spark, d)
    return history.classified(current, past, _event_now()).select("event_id", "fingerprint", "dup_status", "update_of")


def x2_event_memory(spark: SparkSession, d: str) -> DataFrame:
    """The events of all days through a stream that keeps a week of them as state; each day is a run."""
    folder = new_folder(spark, "memory")
    with memory.keyed_state(spark):
        out = memory.classified_stream(adapters.event_stream(spark, d))
        state.run_available(out, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint")
    kind = "event_id bigint, lane string, dup_status string, update_of string, batch bigint"
    return spark.read.schema(kind).parquet(f"{folder}/out").select("event_id", "dup_status", "update_of")


def k5_event_history(spark: SparkSession, d: str) -> DataFrame:
    current, past = _event_sides(spark, d)
    return history.event_history(past, current, _event_now()).select("lane", "fingerprint", "event_id")


def k3_latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("second", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return history.latest_by_key(e, ["user_id"], "second", "event_id").select("user_id", "event_id", "event_type")


def k7_delivery_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "published").when(F.col("event_id") % 3 == 1, "no_qualifying_items").otherwise("failed")
    new = e.select(F.col("event_type").alias("target"), F.col("ts").cast("timestamp").alias("sent_at"), status.alias("run_status"))
    none = new.where("false").withColumn("day", F.current_date())
    out = history.delivery_ledger(none, new)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "target", F.unix_timestamp("sent_at").alias("sent"), "run_status")


def g8_corroboration(spark: SparkSession, d: str) -> DataFrame:
    return corroboration.secondary_hosts(clusters(spark, d), ["fingerprint"])


def j10_supporting_urls(spark: SparkSession, d: str) -> DataFrame:
    out = corroboration.supporting_urls(clusters(spark, d), ["fingerprint"])
    return out.select("candidate_id", "fingerprint", F.array_join("supporting_urls", " ").alias("supporting"))


def w5_boards(spark: SparkSession, d: str) -> DataFrame:
    return boards.boards(scored_items(spark, d)).select("run_id", "board", "rank", "item", "fingerprint", "company", "total")


def _global_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item")
    return scored_items(spark, d).withColumn("status", F.when(k % 4 == 0, "duplicate").when(k % 4 == 1, "material_update").otherwise("unique"))


def w8_global_selection(spark: SparkSession, d: str) -> DataFrame:
    return boards.global_selection(_global_items(spark, d)).select("run_id", "rank", "item", "category", "total")


def j11_without_global(spark: SparkSession, d: str) -> DataFrame:
    shown = w5_boards(spark, d).withColumn("actionable", F.col("item") % 2 == 0)
    return boards.without_global(shown, w8_global_selection(spark, d), "item").select("run_id", "board", "rank", "item")


def j13_audit(spark: SparkSession, d: str) -> DataFrame:
    chosen = w5_boards(spark, d).select("run_id", "item", "board")
    all_items = scored_items(spark, d).select("run_id", "item", "total", "eligible_main")
    return all_items.join(chosen, ["run_id", "item"], "left").groupBy("run_id", F.coalesce("board", F.lit("none")).alias("board")).agg(F.count("*").alias("n"), F.max("total").alias("best"))


def j14_external_selection(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("candidate_id"), F.col("doc_id").alias("position"), (F.col("doc_id") * 13 % 100).alias("importance"))
    unknown = labels.select(F.concat(F.lit("x"), "candidate_id").alias("candidate_id"), "position", "importance")
    return ranking.external_selection(labels.union(unknown), c, 12).select("run_id", "candidate_id", "importance", "rank")


def w15_item_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The first five shown items of a run over all boards, numbered in the run and in their board."""
    order = [F.when(F.col("board") == "must_read", 0).when(F.col("board") == "try_now", 1).otherwise(2), "rank"]
    shown = w5_boards(spark, d).withColumn("number", F.row_number().over(Window.partitionBy("run_id", "board").orderBy("rank")))
    return ranking.top(shown, 5, ["run_id"], order, "position").select("run_id", "board", "item", "number", "position")


def w16_byte_budget(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.fitting_places(table(spark, d, "documents"), 18_000, ["source"], ["doc_id"], "text")
    return out.groupBy("source").agg(F.count("*").alias("n_blocks"), F.max("used").cast("bigint").alias("used"))


def w17_newest_listing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ordered"))
    return o.orderBy(F.col("ordered").desc(), F.col("o_orderkey").desc()).limit(20)


def g1_pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    short = ranking.technical_shortlist(c, now()).groupBy("run_id").agg(F.count("*").alias("n_shortlist"), F.countDistinct("source").alias("n_sources"))
    age = rules.age_hours(F.col("published_at"), now())
    all_of = c.groupBy("run_id").agg(F.count("*").alias("n_candidates"), F.count_if(age.between(0, 24)).alias("n_fresh"), F.min(age).cast("bigint").alias("latest_age"), F.bool_or((age > 48) & (age <= 168)).alias("fallback"))
    return all_of.join(short, "run_id", "left").na.fill(0, ["n_shortlist", "n_sources"])


def _record_struct():
    """A technical record whose flags follow from the number of an order."""
    k = F.col("item")
    flag = lambda m: (k % m == 0)
    some = lambda m, v: F.when(k % m == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(v)))
    date = F.when(k % 5 == 0, "2026-02-30").when(k % 5 == 1, F.lit(None).cast("string")).otherwise("2026-07-01")
    return F.struct(
        flag(11).alias("funding_only"), flag(13).alias("opinion_only"), flag(4).alias("policy_claim"), some(6, "terms").alias("policy_terms"), date.alias("effective_date"),
        flag(17).alias("vague_claim_without_evidence"), flag(19).alias("title_body_conflict"), flag(9).alias("scientific_claim"), flag(2).alias("original_paper_or_independent_validation"),
        some(23, "change").alias("concrete_changes"), F.when(k % 29 == 0, "").otherwise("act").alias("recommended_action"), some(31, "audience").alias("affected_audience"), some(37, "area").alias("affected_area"),
        some(41, "anchor").alias("evidence_anchors"), (k % 43 != 0).alias("evidence_covers_full_claim"), F.when(k % 7 == 0, "insufficient").otherwise("verified").alias("verification_status"),
        F.when(k % 3 == 0, "trusted_secondary").when(k % 3 == 1, "repository").otherwise("paper").alias("source_type"), F.when(k % 8 < 4, "blocked").otherwise("verified").alias("original_source_status"),
        F.when(k % 10 < 3, "direct").when(k % 10 < 6, "adjacent").otherwise("low").alias("relevance_signal"), flag(3).alias("resource_available"), (k % 20).cast("int").alias("action_horizon_days"),
        F.when(k % 2 == 0, "v2").otherwise(" ").alias("version_or_metric"), flag(21).alias("marketing_exaggeration"),
    )


def _status():
    k = F.col("item")
    return F.when(k % 12 == 0, "duplicate").when(k % 12 == 1, "minor_update").when(k % 12 == 2, "material_update").otherwise("unique")


def _gated(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_items(spark, d).select("item", "run_id").withColumn("r", _record_struct()).withColumn("status", _status())
    why = rules.technical_reasons(F.col("r"), F.col("status"))
    return rows.withColumn("why", why)


def r2_technical_gate(spark: SparkSession, d: str) -> DataFrame:
    r, why = F.col("r"), F.col("why")
    return _gated(spark, d).select("item", rules.eligible_main(r, why).alias("main"), rules.eligible_watch(r, why).alias("watch"), F.array_join(why, ",").alias("reasons"))


def g2_rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    counts = _gated(spark, d).select("run_id", F.explode("why").alias("reason")).groupBy("run_id", "reason").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("n").desc(), "reason")))


def r3_technical_score(spark: SparkSession, d: str) -> DataFrame:
    at = now() - F.make_dt_interval(hours=(F.col("item") % 100).cast("int"))
    return _gated(spark, d).select("item", rules.technical_score(F.col("r"), F.col("status"), at, now()).alias("s")).select("item", "s.*")


def r5_global_gate_and_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item")
    flag = lambda m: (k % m == 0)
    scope = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("US"), F.lit(" us "))).otherwise(F.array(F.lit("US"), F.lit("EU")))
    record = F.struct(
        (k % 11 != 0).alias("occurred"), (k % 13 != 0).alias("material_change"), flag(17).alias("funding_only"), flag(19).alias("opinion_only"), flag(4).alias("policy_claim"), flag(8).alias("policy_text_available"),
        flag(23).alias("title_body_conflict"), flag(9).alias("scientific_claim"), flag(2).alias("scientific_verified"), F.when(k % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("evidence_anchors"),
        F.when(k % 7 == 0, "insufficient").otherwise("verified").alias("verification_status"), F.when(k % 3 == 0, "trusted_secondary").otherwise("paper").alias("source_type"),
        F.when(k % 6 == 0, "global").when(k % 6 == 1, "multi_market").when(k % 6 == 2, "single_market").otherwise("niche").alias("impact_scope"), scope.alias("geographic_scope"),
    )
    rows = scored_items(spark, d).select("item").withColumn("r", record).withColumn("status", _status())
    age, hosts = (k % 200 - 5).cast("double"), (k % 4).cast("int")
    why = rules.global_reasons(F.col("r"), hosts, F.col("status"), age)
    return rows.select("item", F.array_join(why, ",").alias("reasons"), rules.global_score(F.col("r"), hosts, F.col("status"), age).alias("s")).select("item", "reasons", "s.*")


def r7_score_backfill(spark: SparkSession, d: str) -> DataFrame:
    caps = {"relevance": 25, "actionability": 20, "specificity": 15, "information_gain": 15, "evidence_quality": 15, "time_sensitivity": 10}
    importance = (F.col("o_orderkey") % 100 + 1).cast("int")
    return table(spark, d, "orders").select("o_orderkey", rules.backfilled_score(importance, caps).alias("s")).select("o_orderkey", "s.*")


def g7_category_share(spark: SparkSession, d: str) -> DataFrame:
    counts = scored_items(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # a row for each category
    return counts.select("category", "n", F.round(share, 6).alias("share"))


def g12_collection_health(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "rss").when(F.col("page_id") % 3 == 1, "web").otherwise("github")
    return p.rollup(kind.alias("collector")).agg(F.count("*").alias("attempted"), F.count_if(F.length("html") > 3000).alias("succeeded")).na.fill("all", ["collector"])


def g13_contract_counts(spark: SparkSession, d: str) -> DataFrame:
    b = w5_boards(spark, d).join(scored_items(spark, d).select("run_id", "item", "category"), ["run_id", "item"])
    of = b.groupBy("run_id").agg((F.count("*") == F.countDistinct("fingerprint")).alias("unique_events"), (F.count("*") == F.countDistinct("item")).alias("unique_items"), F.count("*").alias("n"))
    most = b.groupBy("run_id", "category").agg(F.count("*").alias("c")).groupBy("run_id").agg(F.max("c").alias("most_of_category"))
    return of.join(most, "run_id")


def j2_source_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Orders against customers as candidates against fetched sources: matches, unmatched and repeated ids."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    matched = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_ids"))
    missing = o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_ids")).select(F.lit("unmatched").alias("c_mktsegment"), "n", "n_ids")
    return matched.unionByName(missing)


def j7_literal_anchors(spark: SparkSession, d: str) -> DataFrame:
    """How many benchmark passages each document holds word for word."""
    docs = table(spark, d, "documents").select("doc_id", text.collapsed(F.lower("text")).alias("body"))
    b = table(spark, d, "benchmark").select("item_id", text.collapsed(F.lower("text")).alias("quote"))
    met = anchors.holdings(docs, b).groupBy("doc_id").agg(F.count("*").alias("n_anchors"))
    return docs.select("doc_id").join(met.hint("merge"), "doc_id", "left").na.fill(0, ["n_anchors"])


def w13_summary_pick(spark: SparkSession, d: str) -> DataFrame:
    """The top three items of a run from its last seven days, one for each event; from all days if there are none."""
    items = scored_items(spark, d)
    last = items.groupBy("run_id").agg(F.max("published").alias("last"))
    order = [F.col("total").desc(), F.col("item")]
    once = ranking.top(items, 1, ["run_id", "fingerprint"], order, "nth").join(last, "run_id")
    fresh = once.withColumn("fresh", F.col("last") - F.col("published") <= 168 * 3600)
    picked = ranking.top(fresh, 3, ["run_id"], [F.col("fresh").desc(), *order]).withColumn("any", F.bool_or("fresh").over(Window.partitionBy("run_id")))
    return picked.where(F.col("fresh") | ~F.col("any")).select("run_id", "rank", "item", "total")


def u2_set_operations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    early = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    late = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.collect_set("event_type").alias("b"))
    both = early.join(late, "user_id")
    size = lambda c: F.size(c).cast("bigint")
    return both.select("user_id", size(F.array_except("a", "b")).alias("only_a"), size(F.array_intersect("a", "b")).alias("common"), size(F.array_union("a", "b")).alias("all"))


def _shown(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item")
    url = F.concat(F.when(k % 7 == 0, "http").otherwise("https"), F.lit("://example.com/"), k.cast("string"))
    date = F.when(k % 5 == 0, "2026-02-30").when(k % 5 == 1, F.lit(None).cast("string")).otherwise("2026-07-01")
    return w5_boards(spark, d).withColumn("url", url).withColumn("effective_date", date)


def v1_contract(spark: SparkSession, d: str) -> DataFrame:
    out = compose.violations(_shown(spark, d))
    return out.select("run_id", "item", F.array_join("violations", ",").alias("violations"), "good")


def g4_freshness(spark: SparkSession, d: str) -> DataFrame:
    runs = candidates(spark, d).select("run_id").distinct().union(spark.createDataFrame([("none",)], "run_id string"))
    items = ranking.technical_shortlist(candidates(spark, d), now())
    out = compose.freshness(items, runs, now())
    return out.select("run_id", "n_items", "fresh_count_24h", "run_status", F.coalesce(F.unix_timestamp("latest_published_at"), F.lit(0)).alias("latest"))


def g10_affected_groups(spark: SparkSession, d: str) -> DataFrame:
    events = w8_global_selection(spark, d).withColumn("groups", F.array(F.col("category"), F.concat(F.lit("g"), (F.col("item") % 3).cast("string")), F.lit(" ")))
    return compose.affected_groups(events).select("run_id", F.array_join("groups", ",").alias("groups"))


def t27_overview(spark: SparkSession, d: str) -> DataFrame:
    return compose.overview(scored_items(spark, d).groupBy("run_id", "category").agg(F.count("*").alias("n")))


def t22_action_horizon(spark: SparkSession, d: str) -> DataFrame:
    days = F.when(F.col("item") % 4 == 0, F.lit(None).cast("int")).otherwise((F.col("item") % 40).cast("int"))
    return scored_items(spark, d).groupBy(compose.horizon(days).alias("horizon")).agg(F.count("*").alias("n"))


def v4_upgraded_items(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "pages").select(F.concat(F.lit("r"), (F.col("page_id") % 9).cast("string")).alias("run_id"), "url", (F.col("page_id") * 37 % 100 + 1).alias("importance"))
    old = old.groupBy("run_id", "url").agg(F.max("importance").alias("importance"))
    return compose.upgraded_items(old).select("run_id", "url", "board", "rank", "importance", "fingerprint")


def w4_hard_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.hard_dedupe(candidates(spark, d)).select("run_id", "candidate_id")


def t21_validated_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first line as the claim, its next eight lines as quotes, its whole text as the source."""
    lines = F.split("text", "\n")
    records = table(spark, d, "documents").select(
        "doc_id",
        F.slice(lines, 1, 1).alias("claims"),
        F.slice(lines, 2, 8).alias("quotes"),
        F.col("text").alias("source_text"),
        F.when(F.char_length(text.collapsed(F.col("text"))) >= text.LEAST_CHARACTERS, "verified").otherwise("insufficient").alias("source_status"),
        F.lit(True).alias("covers_full_claim"),
        F.lit("verified").alias("verification_status"),
    )
    return anchors.validated(records).select("doc_id", "n_anchors", "covers_full_claim", "verification_status")


def t15_material(spark: SparkSession, d: str) -> DataFrame:
    """What each turn of a conversation can be compared by."""
    out = table(spark, d, "conversations").select("conv_id", "turn", evidence.profile(F.col("text")).alias("p"))
    return out.select("conv_id", "turn", F.array_join("p.tokens", ",").alias("tokens"), F.size("p.units").cast("bigint").alias("n_units"), "p.directional", "p.direction")


def t17_currencies(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "documents").select("doc_id", evidence.currencies(text.normal_body(F.coalesce("text", F.lit("")))).alias("c"))
    return out.select("doc_id", F.array_join("c", ",").alias("currencies"))


def f11_repository_titles(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(urls.part(F.col("url"), 3), "^/", "")
    return table(spark, d, "pages").select("page_id", path.alias("title")).where(~text.is_repository_name(F.col("title")))


def f17_localised(spark: SparkSession, d: str) -> DataFrame:
    """Titles by language: a German or French text's own first line, else the English one's, else the identifier."""
    docs = table(spark, d, "documents")
    first = F.split("text", "\n", 2)[0]
    own, english = F.when(F.col("lang") != "en", first), F.when(F.col("lang") == "en", first)
    label = text.source_label(F.concat_ws(" · ", "source", "lang"))
    return docs.select("doc_id", text.first_full(own, english, F.col("doc_id").cast("string")).alias("title"), label.alias("label"))


def t24_escaped_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.escaped_markdown(F.col("text"), 300).alias("shown"))


def k8_confirmed_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Events as delivery confirmations: only one of the run's day with a well-formed id and a good status is taken."""
    e = table(spark, d, "events")
    id_ = F.when(F.col("event_id") % 4 == 0, F.upper(F.md5(F.col("event_id").cast("string")))).otherwise(F.md5(F.col("event_id").cast("string")))
    payload = e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("delivery_date"), id_.alias("delivery_id"), F.col("event_type").alias("run_status"))
    return history.confirmed(payload, F.lit(adapters.EVENT_DAY).cast("date"), ("purchase", "click")).select("event_id", "delivery_id")


def x6_day_states(spark: SparkSession, d: str) -> DataFrame:
    """Days of events by their last state: which block another delivery, which have work left."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "click", "uncertain_delivery").otherwise("failed")
    states = e.select(F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), status.alias("delivery_status"), (F.col("value") > 50).alias("sync_pending"), (F.col("user_id") % 3 == 0).alias("dashboard_pending"))
    return history.day_states(states)


def v8_missing_categories(spark: SparkSession, d: str) -> DataFrame:
    """Which of all categories a run has no item of."""
    items = scored_items(spark, d).where("eligible_main AND total >= 60")
    every = F.array(*[F.lit(f"c{k}") for k in range(5)])
    found = items.groupBy("run_id", "category").count().groupBy("run_id").agg(F.collect_set("category").alias("held"))  # five at most
    return found.select("run_id", F.array_join(F.array_sort(F.array_except(every, "held")), ",").alias("missing"))


def r6_two_passes(spark: SparkSession, d: str) -> DataFrame:
    """Which records survive both gates, and why the others do not."""
    rows = scored_items(spark, d).select("item", "run_id").withColumn("r", _record_struct())
    kept, gone = lanes.two_passes(rows, lambda x: x.withColumn("status", _status()))
    shown = lambda x: x.select("item", "run_id", F.array_join("why", ",").alias("reasons"), "status")
    return shown(kept).withColumn("kept", F.lit(True)).unionByName(shown(gone).withColumn("kept", F.lit(False)))


def f15_source_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the kind of source that their link shows, and whether a page of its host without www was asked for."""
    u = F.col("url")
    asked = F.concat(F.lit("https://www."), urls.host(u), F.lit("/"))
    return table(spark, d, "pages").select("page_id", records.source_kind(u).alias("kind"), records.same_host(asked, u).alias("same"))


_TITLE_RECORD = StructType(
    [
        StructField("candidate_id", StringType(), False), StructField("title", StringType(), False), StructField("n_words", LongType(), False),
        StructField("facts", ArrayType(StructType([StructField("name", StringType(), False), StructField("value", LongType(), False)]), False), False),
    ]
)


def _title_record(row: dict) -> object:
    """Answers from the text alone: it takes 8,000 characters at most, breaks its JSON over digits, and mistakes whose title it is after a plural."""
    if len(row["text"]) > 8000:
        raise ValueError("request body too large")
    title = row["title"]
    if any("0" <= c <= "9" for c in title):
        return "{" + title
    words = title.split(" ")
    facts = [{"name": w, "value": len(w)} for w in words[:3]]
    return {"candidate_id": row["id"] + ("0" if words[0].endswith("s") else ""), "title": title, "n_words": len(words), "facts": facts}


def y2_extraction(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each document in extraction: its record, or why there is none, and in how many attempts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), "text", F.substring(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0], 1, 200).alias("title"))
    found = extraction.extracted(docs, _title_record, _TITLE_RECORD, bounds={"$.facts[].name": (1, 12)})
    facts = F.array_join(F.transform("r.facts", lambda x: F.concat_ws(":", x["name"], x["value"])), " ")
    made = found.records.select("candidate_id", "attempts", F.lit("ok").alias("outcome"), F.lit("").alias("detail"), F.col("r.n_words").alias("n_words"), facts.alias("facts"))
    gone = found.audit.select("candidate_id", "attempts", "reason", F.coalesce("detail", F.lit("")), F.lit(-1).cast("bigint"), F.lit(""))
    return made.union(gone)


def _global_answer(row: dict) -> dict:
    """A record with two quotes, the title and one that the text does not have; only the latter where the title has digits, and none after a plural."""
    title = row["title"]
    if title.split(" ")[0].endswith("s"):
        raise ValueError("no answer")
    quotes = [title + " ✗"] if any("0" <= c <= "9" for c in title) else [title, title + " ✗"]
    same = ("title_zh", "what_happened_zh", "why_it_matters_zh")
    return {k: "新闻" for k in same} | {
        "candidate_id": row["id"], "occurred": True, "material_change": True, "category": "policy", "affected_groups_zh": ["公众"], "key_facts": ["事实"], "source_url": "x", "source_type": "paper", "verification_status": "verified",
        "primary_entity": "e", "change_signature": "c", "impact_scope": "global", "evidence_anchors": [{"quote": q, "locator": "first line"} for q in quotes],
    }


def f16_global_records(spark: SparkSession, d: str) -> DataFrame:
    """Every document as the source of a global record: what its anchors and its tier leave of what the answer says."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    made = docs.select(F.col("doc_id").cast("string").alias("candidate_id"), F.substring(F.split("text", "\n", 2)[0], 1, 200).alias("title"), (1 + F.col("doc_id") % 3).alias("source_tier"))
    status = F.when(F.char_length(text.collapsed(F.col("text"))) >= text.LEAST_CHARACTERS, "verified").otherwise("insufficient")
    fetched = docs.select(F.col("doc_id").cast("string").alias("candidate_id"), F.lit("https://h.x/").alias("final_url"), status.alias("status"), "text")
    out = lanes.reading(fetched, _global_answer, is_global=True)(made)
    known = lambda c, none: F.coalesce(c, F.lit(none))
    return out.select("candidate_id", known(F.col("r.source_type"), "").alias("source_type"), known(F.col("r.verification_status"), "").alias("status"), known(F.size("r.evidence_anchors"), -1).alias("n_anchors"), known(F.col("failure.reason"), "").alias("failure"), known(F.col("failure.detail"), "").alias("detail"))


def p1_technical_lane(spark: SparkSession, d: str) -> DataFrame:
    """The technical lane over all runs of candidates, with an extractor that reads a record's flags off its number."""

    def extract(c: DataFrame) -> DataFrame:
        return c.select(
            "run_id", "candidate_id", "url", "source_tier", "published_at", F.col("doc_id").alias("item"), F.col("source").alias("company"), F.col("candidate_id").alias("fingerprint"),
            F.col("url").alias("final_url"), F.lit("verified").alias("source_status"), F.lit(None).cast("string").alias("original_status"),
        ).withColumn("r", _record_struct())

    shown, _ = lanes.technical(candidates(spark, d), lanes.technical_lane(extract, lambda x: x.withColumn("status", _status()), now()), now())
    return shown.select("run_id", "item", "board", "rank", "total")


def t13_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """What of each document fits a prompt of 1,200 tokens beside its title and its source."""
    docs = table(spark, d, "documents")
    title = text.truncated(F.split("text", "\n", 2)[0], 300)
    frame = F.to_json(F.struct(F.col("doc_id").cast("string").alias("candidate_id"), title.alias("source_title"), "source", F.lit("").alias("source_text")))
    out = docs.select("doc_id", text.excerpt(F.col("text"), frame, 1200).alias("excerpt"))
    return out.select("doc_id", F.char_length("excerpt").cast("bigint").alias("n_chars"), F.sha2("excerpt", 256).alias("excerpt_sha256"))


def t22_actions(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first line as a change, whose kind and time limit follow from its number."""
    k = F.col("doc_id")
    kinds = ("pricing_change", "New Policy", "eval", "open_source", "model", "other", "API cost")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (k % len(kinds) + 1).cast("int"))
    first = F.struct(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0].alias("statement"), kind.alias("change_type"))
    days = F.when(k % 5 == 0, F.lit(None).cast("int")).otherwise((k % 45).cast("int"))
    action = actions.recommended(F.array(F.struct(F.lit(" ").alias("statement"), F.lit("policy").alias("change_type")), first), F.array(F.lit(" "), "source"), F.array("lang"), days)
    return table(spark, d, "documents").select("doc_id", action.alias("action"))


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    """The briefing of every run: its boards without what the global events tell, and one run that has nothing."""
    at = F.col("published").cast("timestamp").alias("published_at")
    times = scored_items(spark, d).select("run_id", "item", at)
    shown = w5_boards(spark, d).join(times, ["run_id", "item"]).select("run_id", F.col("item").alias("candidate_id"), "published_at", (F.col("item") % 2 == 0).alias("actionable"))
    events = w8_global_selection(spark, d).join(times, ["run_id", "item"])
    groups = F.array("category", F.concat(F.lit("g"), (F.col("item") % 3).cast("string")))
    events = events.select("run_id", "rank", F.col("item").alias("candidate_id"), F.concat(F.lit("e"), F.col("item").cast("string")).alias("title"), groups.alias("groups"), "published_at")
    counts = scored_items(spark, d).groupBy("run_id").agg(F.count("*").alias("candidate_count"), F.count_if("eligible_watch").alias("global_candidate_count"), F.countDistinct("company").alias("source_count"))
    empty = spark.range(1).select(F.lit("none").alias("run_id"), *[F.lit(0).cast("bigint").alias(c) for c in counts.columns[1:]])
    runs = counts.unionByName(empty).withColumn("lookback_hours", F.lit(36)).withColumn("fallback_used", F.lit(False))
    briefings, _ = compose.daily(runs, shown, events, F.lit("2001-08-02 00:00:00").cast("timestamp"))
    return briefings.withColumn("latest_published_at", F.coalesce(F.unix_timestamp("latest_published_at"), F.lit(0)))


def _global_record() -> Column:
    """A global record whose flags follow from the number of a document; null for one that could not be read."""
    k = F.col("doc_id")
    flag = lambda m: (k % m == 0)
    scope = F.when(k % 5 == 0, F.array(F.lit("US"))).otherwise(F.array(F.lit("US"), F.lit("EU")))
    r = F.struct(
        (k % 11 != 0).alias("occurred"), (k % 13 != 0).alias("material_change"), flag(17).alias("funding_only"), flag(19).alias("opinion_only"), flag(4).alias("policy_claim"), flag(8).alias("policy_text_available"),
        flag(23).alias("title_body_conflict"), flag(9).alias("scientific_claim"), flag(3).alias("scientific_verified"), F.array(F.lit("a")).alias("evidence_anchors"), F.lit("verified").alias("verification_status"),
        F.when(k % 3 == 0, "trusted_secondary").otherwise("paper").alias("source_type"), F.when(k % 6 < 2, "global").otherwise("multi_market").alias("impact_scope"), scope.alias("geographic_scope"), F.col("url").alias("source_url"),
    )
    return F.when(k % 47 != 0, r)


def p2_global_lane(spark: SparkSession, d: str) -> DataFrame:
    """The global lane over all runs of candidates: what became of every candidate of its shortlist."""

    def extract(c: DataFrame) -> DataFrame:
        k = F.col("doc_id")
        named = c.select("run_id", "candidate_id", "doc_id", "published_at", "url", F.col("source").alias("category"), (k / 2).cast("bigint").alias("fingerprint"), k.alias("item"), F.when(k % 10 == 0, "insufficient").otherwise("verified").alias("source_status"))
        return named.withColumn("r", _global_record())

    lane = lanes.GlobalLane(lambda c: ranking.global_shortlist(c, now()), extract, lambda x: x.withColumn("status", _status()))
    _, audit, stats = lanes.global_events(candidates(spark, d), lane, now())
    told = audit.select("run_id", "candidate_id", "source_status", F.array_join("why", ",").alias("reasons"), F.coalesce("total", F.lit(0)).alias("total"), "selected", F.col("n_reports").cast("bigint").alias("n_reports"))
    return told.join(stats.hint("merge"), "run_id")


def _daily_answer(row: dict) -> dict | None:
    """A record of a document's first words, for either lane; some documents have none."""
    told, k = " ".join(row["text"].split()[:12])[:200], int(row["id"])
    if k % 7 == 6 or len(told) < 4:
        return None
    return {
        "candidate_id": row["id"], "title_zh": "消息", "source_url": "https://example.com/", "source_type": "paper", "verification_status": "verified", "primary_entity": f"company {k % 50}", "event_entities": [f"company {k % 50}"],
        "change_signature": "price", "evidence_anchors": [{"quote": told, "locator": "p1"}],
    }


def _daily_technical(row: dict) -> dict | None:
    said = _daily_answer(row)
    return said and said | {
        "summary_zh": "变化", "category": "agents", "concrete_changes": [{"change_type": "pricing", "statement": said["evidence_anchors"][0]["quote"]}], "product_or_model": f"product {row['id']}", "affected_audience": ["customers"],
        "affected_area": ["prices"], "relevance_signal": "direct", "resource_available": True, "action_horizon_days": 3,
    }


def _daily_world(row: dict) -> dict | None:
    said = _daily_answer(row)
    return said and said | {
        "occurred": True, "material_change": True, "category": "models_products", "what_happened_zh": "变化", "why_it_matters_zh": "影响", "affected_groups_zh": ["开发者"], "key_facts": ["变化"], "product_or_policy": f"product {row['id']}",
        "impact_scope": "global", "geographic_scope": ["US"],
    }


def p4_daily_run(spark: SparkSession, d: str) -> DataFrame:
    """One run over all candidates and their documents as pages, to documents within their contract, deliveries and histories; an edition for each language."""
    home, c = new_folder(spark, "daily"), candidates(spark, d)
    html = F.concat(F.lit("<html><body><p>"), F.coalesce("text", F.lit("")), F.lit("</p></body></html>"))
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), html.alias("html"))
    pages = c.select("candidate_id", "url").join(texts.hint("merge"), "candidate_id").select("url", F.col("url").alias("final_url"), F.lit(200).alias("code"), F.lit("text/html").alias("content_type"), "html", now().alias("fetched_at"))
    inputs = daily.Inputs(c, pages, _daily_technical, _daily_world)
    daily.daily_run(spark, home, "day", inputs, c.select("run_id").distinct(), now(), lambda due: due.write.parquet(f"{home}/sent"))
    told = spark.read.parquet(f"{home}/digests/run=day")
    ledger = daily.delivered(spark, home).select(F.col("target").alias("run_id"), F.lit(True).alias("delivered"))
    counts = spark.read.parquet(f"{home}/audit/run=day").groupBy("run_id").agg(F.count("*").alias("n_audited"), F.count_if("selected").alias("n_selected"))
    both = told.join(ledger.hint("merge"), "run_id", "left").join(counts.hint("merge"), "run_id", "left").na.fill(False, ["delivered"]).na.fill(0)
    return both.select("run_id", "run_status", "version", F.array_join("violations", ",").alias("violations"), "good", "delivered", "n_audited", "n_selected")


def f14_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with a record of their own title and first lines as publishable items."""
    c = candidates(spark, d)
    k, lines = F.col("doc_id"), F.split("summary", "\n")
    nothing = F.lit("").alias
    r = F.struct(
        F.col("title").alias("title_zh"), F.col("summary").alias("summary_zh"), F.transform(F.slice(lines, 1, 3), lambda x: F.struct(x.alias("statement"))).alias("concrete_changes"), F.array("lang_hint").alias("affected_audience"),
        F.array("source").alias("affected_area"), F.array("title").alias("recommended_action"), F.col("url").alias("source_url"), F.when(k % 3 == 0, records.SECONDARY).otherwise("paper").alias("source_type"),
        F.when(k % 2 == 0, "blocked").otherwise("verified").alias("original_source_status"), F.lit("verified").alias("verification_status"), F.col("source").alias("primary_entity"), nothing("product_or_model"),
        F.array("source").alias("event_entities"), nothing("change_signature"), nothing("version_or_metric"), F.lit(None).cast("string").alias("effective_date"), (k % 2 == 0).alias("resource_available"), F.lit(False).alias("original_paper_or_independent_validation"),
        F.lit("agents").alias("category"), F.array(*map(F.lit, ("agents", "mcp", "skills", "new_models", "ai_coding"))).alias("extra_categories"),
    )
    both = c.withColumn("lang_hint", F.col("run_id")).withColumn("r", r).withColumn("c", F.struct("candidate_id", "title", "summary", "source", "published_at"))
    made = both.select("candidate_id", records.draft(F.col("c"), F.col("r"), F.col("candidate_id"), F.lit(None).cast("string"), F.lit(70)).alias("draft"))
    return made.select("candidate_id", "draft.verification_status", F.array_join("draft.extra_categories", ",").alias("extra_categories"), F.char_length("draft.concrete_change").cast("bigint").alias("n_change"), F.sha2(F.to_json("draft"), 256).alias("draft_sha256"))


def k6_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries of history."""
    e = event_records(spark, d)
    company = F.regexp_replace("primary_entity", "user", "User ")
    rows = e.withColumn("primary_entity", company).withColumn("event_entities", F.array(F.upper("product_or_model"), F.lit(" "))).withColumn("geographic_scope", F.array(F.lit("EU"))).withColumn("source_url", F.lit(""))
    out = history.snapshots(rows, "technical", F.lit(adapters.NOW).cast("timestamp"))
    return out.select("fingerprint", F.array_join("entities", ",").alias("entities"), "primary_entity", "change_signature", "version_or_metric", "resource_available", F.size("geographic_scope").cast("bigint").alias("n_regions"))


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd'T00:00:00Z'").alias("day"))


def v2_old_digests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as digests of the old form, lines as their items; some break the contract."""
    k, name = F.col("l_partkey"), lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    blank = lambda n: F.lit("").alias(n)
    item = F.struct(
        name("part ", "l_partkey").alias("original_title"), blank("title_en"), blank("summary_en"), blank("title_zh"), blank("summary_zh"),
        F.concat(F.when(k % 97 == 0, "http").otherwise("https"), F.lit("://example.com/"), k.cast("string")).alias("url"), name("supplier ", "l_suppkey").alias("source"), F.col("day").alias("published_at"),
        F.when(k % 89 == 0, "all").otherwise("agents").alias("category"), F.array().cast("array<string>").alias("extra_categories"), (F.col("l_quantity") * 2 + k % 3).cast("bigint").alias("importance"),
    )
    # dealt as lines: grouped first, the far longer items would be
    lines = _order_lines(spark, d).repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"), F.count("*").alias("n"))  # an order has a few lines
    o = F.col("l_orderkey")
    digest = F.struct(
        F.lit(2).alias("schema_version"), F.when(o % 17 == 0, "no_qualifying_items").otherwise("published").alias("run_status"), F.lit("2002-01-01T00:00:00Z").alias("generated_at"),
        (F.col("n") + o % 5 - 1).alias("candidate_count"), F.lit(1).alias("source_count"), F.lit(None).cast("string").alias("latest_published_at"), F.lit(0).alias("fresh_count_24h"), F.lit(36).alias("lookback_hours"),
        F.lit(False).alias("fallback_used"), "items",
    )
    documents = lines.select("l_orderkey", F.to_json(digest, {"ignoreNullFields": "false"}).alias("payload"))
    return contracts.checked(documents).select("l_orderkey", "version", F.array_join("violations", ",").alias("violations"), "good")


def v3_digest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as digests of the present form, lines as their items on boards; some break the contract."""
    k, text_of = F.col("l_partkey"), lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    parts = [(k % n).alias(name) for name, n in (("relevance", 26), ("actionability", 21), ("specificity", 16), ("information_gain", 16), ("evidence_quality", 16), ("time_sensitivity", 11))]
    sums = sum((k % n for n in (26, 21, 16, 16, 16, 11)), F.lit(0))
    penalties = F.when(k % 4 == 0, F.lit(-10)).otherwise(0)
    score = F.struct(*parts, penalties.alias("penalties"), (F.greatest(F.lit(0), sums + penalties) + (k % 61 == 0).cast("int")).alias("total"))
    one, blank = lambda x: F.array(F.lit(x)), F.lit("")
    board = F.when(F.col("l_linenumber") <= 3, "must_read").when(F.col("l_linenumber") <= 5, "try_now").otherwise("watch")
    item = F.struct(
        F.col("candidate").alias("candidate_id"), board.alias("board"), text_of("part ", "l_partkey").alias("original_title"), blank.alias("title_en"), blank.alias("summary_en"), blank.alias("title_zh"), blank.alias("summary_zh"),
        F.lit("change").alias("concrete_change"), one("a").alias("affected_audience"), one("b").alias("affected_area"), one("c").alias("recommended_action"), F.lit("https://example.com/").alias("evidence_url"),
        F.lit("verified").alias("verification_status"), text_of("s", "l_suppkey").alias("event_fingerprint"), F.lit(None).cast("string").alias("update_of"), F.lit("p").alias("primary_entity"), blank.alias("product_or_model"),
        F.array().cast("array<string>").alias("event_entities"), F.lit("s").alias("change_signature"), blank.alias("version_or_metric"), F.when(k % 101 == 0, "2026-02-30").alias("effective_date"), F.lit(True).alias("resource_available"),
        F.lit(False).alias("scientific_verified"), F.lit("source").alias("source"), F.col("day").alias("published_at"), F.lit("mcp").alias("category"), one("skills").alias("extra_categories"), score.alias("score"),
    )
    lines = _order_lines(spark, d)
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = lines.withColumn("candidate", F.concat_ws("-", "l_orderkey", number)).select("l_orderkey", "day", item.alias("item"))
    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("item.board", "item.candidate_id", "item"))).alias("x"), F.max("day").alias("latest"))
    of = {b: F.transform(F.filter("x", lambda e: e["board"] == b), lambda e: e["item"]) for b in compose.BOARD_LIMITS}  # noqa: B023
    none = F.create_map().cast("map<string, int>")
    stats = lambda rejected: F.struct(F.lit(40).alias("candidate_count"), rejected.alias("shortlist_count"), F.lit(0).alias("source_verified_count"), F.lit(0).alias("rejected_count"), none.alias("top_rejection_reasons"))
    o = F.col("l_orderkey")
    digest = F.struct(
        F.lit(4).alias("schema_version"), F.lit("published").alias("run_status"), F.concat(F.substring("latest", 1, 10), F.when(o % 3 == 0, "T12:00:00Z").otherwise("T00:00:00Z")).alias("generated_at"), F.lit(40).alias("candidate_count"),
        F.lit(2).alias("source_count"), F.col("latest").alias("latest_published_at"), F.lit(1).alias("fresh_count_24h"), F.lit(48).alias("lookback_hours"), F.lit(False).alias("fallback_used"), F.struct(*[v.alias(b) for b, v in of.items()]).alias("boards"),
        F.concat(*of.values()).alias("items"), stats(F.size("x")).alias("pipeline_stats"), F.when(o % 29 == 0, " ").otherwise("told").alias("daily_narrative_zh"), F.array().cast("array<string>").alias("global_events"),
        stats(F.lit(0)).alias("global_pipeline_stats"),
    )
    documents = listed.select("l_orderkey", F.to_json(digest, {"ignoreNullFields": "false"}).alias("payload"))
    return contracts.checked(documents).select("l_orderkey", "version", F.array_join("violations", ",").alias("violations"), "good")


def _item_cards(spark: SparkSession, d: str) -> DataFrame:
    k, one = F.col("item"), lambda x: F.array(F.lit(x))
    texts = {"title_zh": F.concat(F.lit("item_"), k.cast("string")), "concrete_change": F.concat(F.lit("change [of] "), F.col("company").cast("string"))}
    lists = {"affected_audience": F.array(F.lit("a"), F.lit("b*")), "affected_area": one("area"), "recommended_action": one("act")}
    status = F.when(k % 2 == 0, "blocked").otherwise("verified")
    url = F.concat(F.lit("https://example.com/("), k.cast("string"), F.lit(")?q=é"))
    return w5_boards(spark, d).withColumns(texts | lists | {"verification_status": status, "evidence_url": url})


def t25_item_lines(spark: SparkSession, d: str) -> DataFrame:
    """Items on boards as the lines that a briefing shows."""
    rows = _item_cards(spark, d)
    return rows.select("run_id", "item", cards.item_text(F.struct(*rows.columns)).alias("lines"))


def t26_cards(spark: SparkSession, d: str) -> DataFrame:
    """The card of every run, and of one that has nothing."""
    at = F.lit("2001-08-02 00:00:00").cast("timestamp")
    events = w8_global_selection(spark, d).join(scored_items(spark, d).select("run_id", "item", F.col("published").cast("timestamp").alias("published_at")), ["run_id", "item"])
    told = {c: F.concat(F.lit(f"{c} "), F.col("item").cast("string")) for c in ("title_zh", "what_happened_zh", "why_it_matters_zh", "source_name")}
    kinds = F.array(*map(F.lit, cards.EVENT_LABELS))
    events = events.withColumns(told | {"affected_groups_zh": F.array("category"), "key_facts": F.array("category"), "source_url": F.lit("https://example.com/"), "category": F.element_at(kinds, (F.col("item") % 5 + 1).cast("int"))})
    runs = p3_daily(spark, d).select("run_id", "run_status", "narrative", "candidate_count").withColumn("generated_at", at)
    zero = F.lit(0).cast("bigint")
    runs = runs.withColumns({"shortlist_count": zero, "source_verified_count": zero, "rejected_count": zero, "reasons": F.array().cast("array<struct<reason: string, n: bigint>>")})
    out = cards.rendered(runs, events, _item_cards(spark, d))
    return out.select("run_id", "content", "n_events", "n_items", F.octet_length("card").cast("bigint").alias("card_bytes"))
