"""Records' bounds and sources, and a lane with its own steps."""

import pytest
from pyspark.sql import functions as F

from briefloom.functions import records, text
from briefloom.operators import lanes
from briefloom.plans import queries, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("https://github.com/a/b", "repository"), ("https://gist.github.com/a", "repository"), ("https://notgithub.com/a", "official_announcement"),
        ("https://huggingface.co/a/blob/main/x", "model_card"), ("https://huggingface.co/a", "official_announcement"), ("https://arxiv.org/abs/1", "paper"),
        ("https://www.sec.gov/x", "financial_filing"), ("https://x.gov.cn/", "law_or_regulation"), ("https://nist.gov/", "law_or_regulation"),
    ],
)
def test_source_kinds(spark, url, kind):
    assert spark.createDataFrame([(url,)], "u string").select(records.source_kind(F.col("u"))).first()[0] == kind


def test_bounds_and_provenance(spark):
    schema = "r struct<title_zh: string, effective_date: string, affected_area: array<string>, source_url: string, source_type: string, original_source_status: string>"
    row = ("x" * 100 + " token=abc", "2026-02-30", ["a", " ", "token=hidden", "d", "e", "f"], "https://h.x/a?token=t", "paper", None)
    df = spark.createDataFrame([(row,)], schema)
    r = df.select(records.bounded(F.col("r"), df.schema["r"].dataType).alias("r")).first().r
    assert len(r.title_zh) == 80 and r.effective_date is None and r.affected_area == ["a", "token=[REDACTED]", "d", "e"]
    assert r.source_url == "https://h.x/a?token=REDACTED"[:1000] or "REDACTED" in r.source_url
    own = lambda tier, asked, found, original: df.select(records.with_provenance(F.col("r"), F.lit(tier), F.lit(asked), F.lit(found), F.lit(original).cast("string")).alias("r")).first().r
    assert own(1, "https://www.arxiv.org/", "https://arxiv.org/abs/1", None).source_type == "paper"
    assert own(3, "https://arxiv.org/", "https://arxiv.org/abs/1", None).source_type == "trusted_secondary"
    assert own(1, "https://a.x/", "https://b.x/", "blocked").original_source_status == "blocked"


def test_only_survivors_are_classified(spark):
    rows = queries.scored_items(spark, FOLDER).select("item", "run_id").withColumn("r", queries._record_struct())
    seen = []

    def classify(df):
        seen.append(df.count())
        return df.withColumn("status", F.lit("duplicate"))

    kept, gone = lanes.two_passes(rows, classify)
    assert 0 < seen[0] < rows.count() and kept.count() == 0 and gone.count() == rows.count()
    assert gone.where("status = 'duplicate'").where(F.array_contains("why", "duplicate_without_material_update")).count() == seen[0]


def test_lane_of_runs(spark):
    shown = registry.QUERIES["p1_technical_lane"](spark, FOLDER).collect()
    assert len({(r.run_id, r.item) for r in shown}) == len(shown)
    assert all(r["rank"] >= 1 and r.total >= 50 for r in shown)


PAGE = "<html><head><title>T</title></head><body><p>Acme cuts the price of Gizmo from $20 to $10 for all customers on Monday, its largest cut so far.</p><p>{}</p></body></html>"


def test_lanes_read_their_records_from_pages(spark):
    """Records whose quotes do not stand in their page are rejected, and so is what gave no record."""
    answers = {
        "good": "Acme cuts the price of Gizmo from $20 to $10", "wide": "ＡＣＭＥ cuts  the price of gizmo from $20 to $10", "false": "Acme raises the price of Gizmo from $10 to $20", "other": "its largest cut so far", "none": None, "short": "Acme cuts the price of Gizmo from $20 to $10",
    }

    def call(row):
        quote = answers[row["title"]]
        if quote is None:
            raise RuntimeError("down")
        return {
            "candidate_id": row["id"], "title_zh": "降价消息", "summary_zh": "价格下调", "category": "models", "source_url": "https://evil.x/", "source_type": "law_or_regulation", "verification_status": "verified",
            "concrete_changes": [{"change_type": "pricing", "statement": "Acme cuts the price of Gizmo from $20 to $10"}], "evidence_anchors": [{"quote": quote, "locator": "p1"}, {"quote": "not in the page", "locator": "p2"}],
            "affected_audience": ["customers"], "affected_area": ["prices"], "primary_entity": "acme", "change_signature": "price", "relevance_signal": "direct", "resource_available": True,
        }

    names = list(answers)
    rows = [("r1", f"c{i}", n, 1, "https://a.x/") for i, n in enumerate(names)]
    made = spark.createDataFrame(rows, "run_id string, candidate_id string, title string, source_tier int, url string").withColumn("published_at", F.lit("2026-07-14 10:00:00").cast("timestamp")).withColumn("item", F.col("candidate_id"))
    pages = spark.createDataFrame([(f"c{i}", PAGE.format("More text. " * 20) if n != "short" else "<p>Acme cuts the price of Gizmo from $20 to $10</p>") for i, n in enumerate(names)] + [("c99", "unused")], "candidate_id string, html string")
    fetched = pages.select("candidate_id", F.lit("https://a.x/found").alias("final_url"), text.page_content(F.col("html")).alias("p")).select("candidate_id", "final_url", "p.status", "p.text")
    read = lanes.reading(fetched, call)
    at = F.lit("2026-07-14 12:00:00").cast("timestamp")
    got = {r.title: r for r in read(made).collect()}
    assert {n: (len(r.r.evidence_anchors), r.r.verification_status, r.r.evidence_covers_full_claim) if r.r else r.failure.reason for n, r in got.items()} == {
        "good": (1, "verified", True), "wide": (1, "verified", True), "false": (0, "insufficient", False), "other": (1, "insufficient", False), "none": "failed", "short": (1, "insufficient", True),
    }
    assert got["good"].r.source_url == "https://a.x/found" and got["good"].r.recommended_action
    keyed = lambda df: read(df).withColumns({"company": F.col("candidate_id"), "fingerprint": F.col("candidate_id")})
    lane = lanes.Lane(lambda c: c, keyed, lambda x: x.withColumn("status", F.lit("unique")))
    shown, rejected = lanes.technical(made, lane, at)
    assert {r.title for r in shown.collect()} == {"good", "wide"}
    why = {r.title: r.why for r in rejected.collect()}
    assert why["none"] == ["evidence_extraction_failed"] and all("invalid_evidence_anchor" in why[n] for n in ("false", "other")) and why["short"] == ["unverified_primary_source"]


def test_sources_of_records(spark):
    df = spark.createDataFrame([(("paper", "verified"),)], "r struct<source_type: string, verification_status: string>")
    own = lambda tier, status: tuple(df.select(records.global_provenance(F.col("r"), F.lit(tier), F.lit(status)).alias("r")).first().r)
    assert own(1, "blocked") == ("official_announcement", "blocked") and own(2, "verified") == ("trusted_secondary", "verified")
