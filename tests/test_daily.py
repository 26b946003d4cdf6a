"""The daily run: from landed files to documents within their contract, deliveries and histories, repeated after crashes."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from briefloom.operators import history
from briefloom.plans import daily
from briefloom.sources import landed

FIRST, NEXT = "2026-07-14 12:00:00", "2026-07-15 12:00:00"
TITLES = {
    "good": "Acme launches Gizmo API v2", "false": "Borealis releases Widget SDK 3.1 for phones", "gone": "Cobalt open source model 7B weights", "other": "Dunlin agents benchmark 2026 results API", "world": "Egret signs a law on models with API access",
    "both": "Falcon cuts the price of Kite API v5", "failed": "Grebe updates Sonar SDK v9 with tools",
}
TOLD = "{} cuts the price of {} from $20 to $10"
PAGE = "<html><head><title>T</title></head><body><p>{} for all customers on Monday, its largest cut so far.</p><p>{}</p></body></html>"


def at(day):
    return F.lit(day).cast("timestamp")


def technical(row):
    name = next(n for n, t in TITLES.items() if t == row["title"])
    if name in ("failed", "world"):
        raise RuntimeError("down")
    told = TOLD.format(name, name + "kit")
    quote = told if name != "false" else "something that the page does not say at all"
    return {
        "candidate_id": row["id"], "title_zh": "降价消息", "summary_zh": "价格下调", "category": "agents" if name != "both" else "industry_business", "source_url": "https://evil.x/", "source_type": "paper", "verification_status": "verified",
        "concrete_changes": [{"change_type": "pricing", "statement": told}], "evidence_anchors": [{"quote": quote, "locator": "p1"}], "affected_audience": ["customers"], "affected_area": ["prices"], "primary_entity": name,
        "product_or_model": name + "kit", "change_signature": "price", "relevance_signal": "direct", "resource_available": True, "action_horizon_days": 3, "event_entities": [name],
    }


def world(row):
    name = next(n for n, t in TITLES.items() if t == row["title"])
    if name not in ("world", "both"):
        return None
    return {
        "candidate_id": row["id"], "occurred": True, "material_change": True, "category": "policy_regulation", "title_zh": "法律签署", "what_happened_zh": "签署了法律", "why_it_matters_zh": "影响所有模型", "affected_groups_zh": ["开发者"],
        "key_facts": ["价格下调"], "evidence_anchors": [{"quote": TOLD.format(name, name + "kit"), "locator": "p1"}], "source_url": "https://evil.x/", "source_type": "paper", "verification_status": "verified", "primary_entity": name,
        "change_signature": "law", "impact_scope": "global", "event_entities": [name], "geographic_scope": ["US"],
    }


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    item = "<item><title>{}</title><link>https://{}.x/{}</link><description>an llm</description><pubDate>Tue, 14 Jul 2026 10:00:00 GMT</pubDate></item>"
    for source, names in {"first": ("good", "false", "gone", "world", "both"), "second": ("other", "failed", "good"), "quiet": ()}.items():
        (folder / "feeds" / source).mkdir(parents=True)
        items = "".join(item.format(TITLES[n], n, n) for n in names)
        (folder / "feeds" / source / "f.xml").write_text(f"<rss><channel><title>F</title>{items}</channel></rss>")
    sources = landed.source_table(spark, [("first", 1, 1.0, False), ("second", 2, 0.9, False), ("quiet", 1, 1.0, False), ("dead", 1, 1.0, False)])
    editions = spark.createDataFrame([("main", s, ["global", "technical"]) for s in ("first", "second")] + [("none", "quiet", ["technical"]), ("none", "dead", ["technical"])], "run_id string, source string, lane_hints array<string>")
    pages = [(f"https://{n}.x/{n}?utm_source=q", f"https://{n}.x/{n}", 403 if n == "gone" else 200, "text/html", PAGE.format(TOLD.format(n, n + "kit"), "More text. " * 20), FIRST) for n in TITLES]
    pages.append(("https://good.x/good", "https://good.x/old", 500, "text/html", "an earlier fetch", "2026-07-13 00:00:00"))
    pages = spark.createDataFrame(pages, "url string, final_url string, code int, content_type string, html string, fetched_at string")
    rows = daily.collected(spark, str(folder / "feeds"), sources, editions, at(FIRST))
    return daily.Inputs(rows, pages, technical, world), editions


def test_collected(spark, inputs, tmp_path):
    rows = inputs[0].candidates.collect()
    assert sorted((r.run_id, r.url.rsplit("/", 1)[1], r.source) for r in rows) == sorted(("main", n, "second" if n in ("other", "failed") else "first") for n in TITLES)
    (tmp_path / "feeds" / "first").mkdir(parents=True)
    (tmp_path / "feeds" / "first" / "f.xml").write_text("<html>no feed</html>")
    sources = landed.source_table(spark, [("first", 1, 1.0, False)])
    with pytest.raises(PySparkException, match="every collector failed"):
        daily.collected(spark, str(tmp_path / "feeds"), sources, inputs[1], at(FIRST))


def test_a_run_is_repeated_without_loss(spark, inputs, tmp_path, monkeypatch):
    home, sent = str(tmp_path), []
    tables = lambda name: spark.read.parquet(f"{home}/{name}/run=d1")

    def keep(due, day="d1"):
        sent.extend((day, r.run_id, r.payload) for r in due.collect())

    def broken(*args, **kwargs):
        raise RuntimeError("crashed")

    # what an attempt left that ended before its documents
    spark.createDataFrame([("main", "left over")], "run_id string, source_url string").write.parquet(f"{home}/told/run=d1")
    daily.generate(spark, home, "d1", *inputs, at(FIRST))
    with pytest.raises(RuntimeError, match="crashed"):  # while it sends
        daily.deliver(spark, home, "d1", broken, at(FIRST))
    assert not (tmp_path / "ledger").exists()
    snapshots = history.snapshots
    with monkeypatch.context() as m:  # after the ledger, before the histories: only deliver() keeps the editions' name alone
        m.setattr(history, "snapshots", lambda rows, lane, now, keep=(): broken() if keep == ("run_id",) else snapshots(rows, lane, now, keep))
        with pytest.raises(RuntimeError, match="crashed"):
            daily.deliver(spark, home, "d1", keep, at(FIRST))
    assert len(sent) == 2 and not (tmp_path / "events").exists()
    first = {r.run_id: r.payload for r in tables("digests").collect()}
    for _ in range(2):  # makes up for the histories; then nothing is left
        daily.daily_run(spark, home, "d1", *inputs, at(FIRST), keep)
    assert len(sent) == 2 and {r.run_id: r.payload for r in tables("digests").collect()} == first == {run_id: payload for _, run_id, payload in sent}

    documents = {r.run_id: r for r in tables("digests").collect()}
    assert {k: (r.good, r.violations, r.run_status) for k, r in documents.items()} == {"main": (True, [], "published"), "none": (True, [], "no_qualifying_items")}
    main, none = (json.loads(documents[k].payload) for k in ("main", "none"))
    assert sorted(x["primary_entity"] for x in main["items"]) == ["good", "other"] and sorted(x["primary_entity"] for x in main["global_events"]) == ["both", "world"]
    assert main["candidate_count"] == 7 and main["source_count"] == 2 and main["fresh_count_24h"] == 4 and not main["fallback_used"] and none["fallback_used"] and none["lookback_hours"] == 168
    stats = main["pipeline_stats"]
    assert stats["shortlist_count"] == 7 and stats["rejected_count"] == 5 and stats["source_verified_count"] == 6
    assert stats["top_rejection_reasons"][daily.TOLD_GLOBALLY] == 1 and stats["top_rejection_reasons"]["evidence_extraction_failed"] == 2

    audit = {(r.lane, r.candidate_id): r for r in tables("audit").collect()}
    ids = {r.url.rsplit("/", 1)[1]: r.candidate_id for r in inputs[0].candidates.collect()}
    assert len(audit) == 14 and audit["technical", ids["gone"]].source_status == "blocked" and audit["technical", ids["both"]].why == [daily.TOLD_GLOBALLY] and audit["technical", ids["good"]].board
    assert "invalid_evidence_anchor" in audit["technical", ids["false"]].why and audit["global", ids["good"]].why == ["global_extraction_failed"]
    assert sorted(r.url for r in tables("urls").collect()) == [f"https://{n}.x/{n}" for n in ("both", "good", "other", "world")]
    assert sorted((r.lane, r.primary_entity) for r in tables("events").collect()) == [("global", "both"), ("global", "world"), ("technical", "good"), ("technical", "other")]

    spark.read.parquet(f"{home}/digests/run=d1").write.parquet(f"{home}/digests/run=d1b")
    spark.read.parquet(f"{home}/told/run=d1").write.parquet(f"{home}/told/run=d1b")
    daily.deliver(spark, home, "d1b", broken, at(FIRST))  # the same day under another name: nothing is due
    assert spark.read.parquet(f"{home}/events/run=d1b").isEmpty()

    # the next day: what was sent is not told again, and another page of a known event is no news, but in an edition that has not told it
    again = inputs[0].candidates.where(F.col("url").endswith("/good")).withColumn("url", F.lit("https://good.x/again"))
    again = again.withColumn("candidate_id", F.lit("main-again")).unionByName(again.withColumns({"run_id": F.lit("fresh"), "candidate_id": F.lit("fresh-again")}))
    page = inputs[0].pages.where(F.col("url").endswith("/good?utm_source=q")).withColumns({"url": F.lit("https://good.x/again"), "final_url": F.lit("https://good.x/again")})
    later = inputs[0]._replace(candidates=inputs[0].candidates.unionByName(again), pages=inputs[0].pages.unionByName(page))
    editions = inputs[1].select("run_id").unionByName(again.select("run_id")).distinct()
    daily.daily_run(spark, home, "d2", later, editions, at(NEXT), lambda due: keep(due, "d2"))
    assert sorted((i, json.loads(p)["run_status"]) for d, i, p in sent if d == "d2") == [("fresh", "published"), ("main", "no_qualifying_items"), ("none", "no_qualifying_items")]
    audit = {r.candidate_id: r for r in spark.read.parquet(f"{home}/audit/run=d2").where("lane = 'technical'").collect()}
    assert audit["main-again"].status == "duplicate" and audit["main-again"].why == ["duplicate_without_material_update"] and audit["fresh-again"].status == "unique" and audit["fresh-again"].board
    assert not {ids["good"], ids["other"], ids["both"], ids["world"]} & set(audit)
