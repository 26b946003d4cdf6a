"""Excerpts, actions, drafts, snapshots, lanes, contracts and cards, against plain versions and small vectors."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from briefloom.functions import actions, text
from briefloom.operators import cards, contracts, history, lanes, ranking
from briefloom.plans import queries, registry
from briefloom.sources import landed

FOLDER = "/root/testdata/sf0.001"


def tokens(value):
    wide = len(re.findall("[㐀-鿿]", value))
    return wide + (len(value) - wide + 2) // 3


def shortened(value, limit):
    return value if len(value) <= limit else value[: max(0, limit - 1)].rstrip() + "…"


def test_excerpts_are_the_longest_that_fit():
    rng = random.Random(4)
    for _ in range(400):
        value = "".join(rng.choice('ab 中文"\\\x08\x01é🙂\n ') for _ in range(rng.randint(0, 60)))
        flat = " ".join(value.split())
        frame, budget = json.dumps({"a": "x" * rng.randint(0, 20) + "字"}, ensure_ascii=False), rng.randint(0, 40)
        wide = len(re.findall("[㐀-鿿]", frame))
        fits = [n for n in range(1, len(flat) + 1) if tokens(frame + json.dumps(shortened(flat, n), ensure_ascii=False)[1:-1]) <= budget]
        assert text.excerpt_within(value, wide, len(frame) - wide, budget) == (shortened(flat, max(fits)) if fits else "")


def test_excerpts_of_columns(spark):
    df = spark.createDataFrame([("word " * 900, "{}"), (None, "{}"), ("", "{}"), ("short", "{}")], "t string, f string")
    got = [r[0] for r in df.select(text.excerpt(F.col("t"), F.col("f"), 100)).collect()]
    assert got[1:] == [None, "", "short"] and tokens("{}" + got[0]) <= 100 < tokens("{}" + got[0] + " wo")


@pytest.mark.parametrize(
    ("kind", "audience", "days", "action"),
    [
        ("PRICING", ["  ", " all\tusers "], 0, "all users应在今天按当前用量重新计算area，并与当前方案对比。依据：It  costs".replace("  ", " ")),
        ("api_release", ["x"], 90, "x应在30天内先在非生产环境验证area的兼容性、性能和成本，再决定是否采用。依据：It costs"),
        ("api pricing", ["x"], None, "x应在7天内按当前用量重新计算area，并与当前方案对比。依据：It costs"),
        ("unheard", ["x"], 1, "x应在1天内针对area进行小范围验证，再决定是否扩大使用。依据：It costs"),
        ("model", ["", " "], 1, None),
    ],
)
def test_actions(spark, kind, audience, days, action):
    df = spark.createDataFrame([([("  ", "policy"), ("It  costs", kind)], audience, ["area"], days)], "c array<struct<statement: string, change_type: string>>, a array<string>, b array<string>, d int")
    assert df.select(actions.recommended(F.col("c"), F.col("a"), F.col("b"), F.col("d"))).first()[0] == action


def test_long_actions_are_cut(spark):
    df = spark.createDataFrame([([("y" * 900, "eval")], ["x" * 20], ["area"], 3)], "c array<struct<statement: string, change_type: string>>, a array<string>, b array<string>, d int")
    found = df.select(actions.recommended(F.col("c"), F.col("a"), F.col("b"), F.col("d"))).first()[0]
    assert len(found) == 300 and found.endswith("y…") and "。依据：yy" in found


def test_snapshots(spark):
    kind = "fingerprint string, primary_entity string, product_or_model string, change_signature string, version_or_metric string, effective_date string, event_entities array<string>, source_url string, resource_available boolean, geographic_scope array<string>"
    df = spark.createDataFrame([("f", "Open  X", "Ｍ1", "New", None, None, ["B", " ", "open x"], "u", True, ["E U"])], kind)
    t = history.snapshots(df, "technical", F.lit("2026-01-01").cast("timestamp")).first()
    assert t.entities == ["b", "m1", "open%20x"] and t.product_or_model == "m1" and t.version_or_metric == "" and t.resource_available and t.geographic_scope == []
    g = history.snapshots(df, "global", F.lit("2026-01-01").cast("timestamp")).first()
    assert g.geographic_scope == ["e%20u"] and not g.resource_available and g.lane == "global" and g.source_type == ""


def test_global_lane_tells_of_every_candidate(spark):
    c = queries.candidates(spark, FOLDER)
    rows = registry.QUERIES["p2_global_lane"](spark, FOLDER).collect()
    short = ranking.global_shortlist(c, queries.now()).count()
    assert len(rows) == short and {r.run_id for r in rows if r.selected}
    for run in {r.run_id for r in rows}:
        own = [r for r in rows if r.run_id == run]
        assert own[0].shortlist_count == len(own) and own[0].rejected_count == sum(not r.selected for r in own)
        assert sum(r.selected for r in own) <= 5 and all(r.reasons == "" and r.total >= 65 for r in own if r.selected)
        assert own[0].source_verified_count == sum(r.source_status == "verified" for r in own)
    failed = [r for r in rows if r.reasons == "global_extraction_failed"]
    assert {int(r.candidate_id) % 47 for r in failed} <= {0} and all(r.n_reports == 0 for r in failed)


def test_drafts(spark):
    rows = {int(r.candidate_id): r for r in registry.QUERIES["f14_drafts"](spark, FOLDER).collect()}
    assert len(rows) == queries.candidates(spark, FOLDER).count()
    assert rows[0].verification_status == rows[6].verification_status == "blocked" and rows[3].verification_status == rows[1].verification_status == rows[2].verification_status == "verified"
    assert rows[0].extra_categories == "mcp,skills,new_models" and all(r.n_change <= 1200 for r in rows.values())


def item(n, board):
    score = {k: 5 for k in contracts.SCORE_CAPS} | {"penalties": -10, "total": 20}
    return {
        "candidate_id": f"c{n}", "board": board, "original_title": "t", "title_en": "", "summary_en": "", "title_zh": "", "summary_zh": "", "concrete_change": "x", "affected_audience": ["a"], "affected_area": ["b"],
        "recommended_action": ["c"], "evidence_url": "https://x.org/", "verification_status": "verified", "event_fingerprint": f"f{n}", "update_of": None, "primary_entity": "p", "product_or_model": "", "event_entities": [],
        "change_signature": "s", "version_or_metric": "", "effective_date": None, "resource_available": True, "scientific_verified": False, "source": "s", "published_at": f"2026-07-0{n}T00:00:00Z", "category": "mcp",
        "extra_categories": [], "score": score,
    }


def event(n, category="models_products"):
    score = dict(contracts.EVENT_SCORE_CAPS) | {"total": 100}
    return {
        "event_id": f"e{n}", "candidate_id": f"g{n}", "category": category, "title_zh": "t", "what_happened_zh": "w", "why_it_matters_zh": "y", "affected_groups_zh": ["a"], "key_facts": ["k"], "source_name": "n",
        "source_url": "https://x.org/", "supporting_urls": [], "published_at": "2026-07-03T00:00:00Z", "primary_entity": "p", "product_or_policy": "", "change_signature": "s", "version_or_metric": "",
        "effective_date": "2026-07-01", "event_entities": ["x"], "score": score,
    }


def digest():
    boards = {"must_read": [item(1, "must_read"), item(2, "must_read")], "try_now": [], "watch": [item(3, "watch")]}
    stats = lambda n: {"candidate_count": 9, "shortlist_count": n, "source_verified_count": 3, "rejected_count": 1, "top_rejection_reasons": {"funding_only": 1}}
    return {
        "schema_version": 4, "run_status": "published", "generated_at": "2026-07-03T12:00:00Z", "candidate_count": 9, "source_count": 2, "latest_published_at": "2026-07-03T00:00:00Z", "fresh_count_24h": 2, "lookback_hours": 48,
        "fallback_used": False, "boards": boards, "items": sum(boards.values(), []), "pipeline_stats": stats(4), "daily_narrative_zh": "n", "global_events": [event(1)], "global_pipeline_stats": stats(4),
    }


def changed(change):
    d = copy.deepcopy(digest())
    change(d)
    return d


def both(d, n, **fields):
    """Changes the n-th item where it stands twice."""
    d["items"][n].update(fields)
    own = [x for b in d["boards"].values() for x in b][n]
    own.update(fields)


def third(d):
    for k in ("daily_narrative_zh", "global_events", "global_pipeline_stats"):
        del d[k]
    d.update(schema_version=3, fresh_count_24h=1)


CASES = {
    "good": (lambda d: None, ""),
    "third form": (third, ""),
    "more fields": (lambda d: d.update(x=1), "bad_shape"),
    "a field less": (lambda d: d.pop("source_count"), "bad_shape,bad_counts"),
    "number as text": (lambda d: d.update(lookback_hours="48"), "bad_shape"),
    "blank narrative": (lambda d: d.update(daily_narrative_zh=" "), "bad_shape"),
    "too many sources": (lambda d: d.update(source_count=10), "bad_counts"),
    "shortlist": (lambda d: d["pipeline_stats"].update(shortlist_count=5), "bad_counts"),
    "reason": (lambda d: d["global_pipeline_stats"]["top_rejection_reasons"].update(x=-1), "bad_counts"),
    "no audience": (lambda d: both(d, 0, affected_audience=[]), "bad_item"),
    "day": (lambda d: both(d, 1, effective_date="2026-02-30"), "bad_item"),
    "item's field": (lambda d: both(d, 1, more=1), "bad_item"),
    "link": (lambda d: both(d, 2, evidence_url="http://x.org/"), "bad_item"),
    "sum": (lambda d: both(d, 0, score=item(1, "x")["score"] | {"total": 21}), "bad_score"),
    "board": (lambda d: both(d, 0, board="watch"), "bad_boards"),
    "order": (lambda d: d["items"].reverse(), "bad_order"),
    "same candidate": (lambda d: both(d, 1, candidate_id="c1"), "repeated"),
    "event among items": (lambda d: both(d, 1, event_fingerprint="e1"), "repeated"),
    "no facts": (lambda d: d["global_events"][0].update(key_facts=[]), "bad_event"),
    "three of a kind": (lambda d: (d["global_events"].extend([event(2), event(3)]), d.update(fresh_count_24h=4)), "crowded_category"),
    "status": (lambda d: d.update(run_status="no_qualifying_items"), "bad_status"),
    "fresh": (lambda d: d.update(fresh_count_24h=3), "bad_freshness"),
    "latest": (lambda d: d.update(latest_published_at="2026-07-02T00:00:00Z"), "bad_freshness"),
    "latest elsewhere": (lambda d: d.update(latest_published_at="2026-07-03T08:00:00+08:00"), ""),
    "version": (lambda d: d.update(schema_version=5), "unknown_version"),
}


def test_contract_of_documents(spark, tmp_path):
    rows = [(name, json.dumps(changed(change), ensure_ascii=False)) for name, (change, _) in CASES.items()]
    rows += [("json", "{"), ("list", "[]"), ("null", None), ("large", " " * contracts.BODY_BYTES + "{}")]
    got = {r.name: ",".join(r.violations) for r in contracts.checked(spark.createDataFrame(rows, "name string, payload string")).collect()}
    assert got == {name: codes for name, (_, codes) in CASES.items()} | {"json": "bad_json", "list": "unknown_version", "null": "bad_json", "large": "too_large"}
    (tmp_path / "a.json").write_text(json.dumps(digest()))
    (tmp_path / "b.json").write_bytes(b'{"schema_version": 2, "x": "\xff"}')
    found = {r.path[-6:]: (r.good, r.violations) for r in landed.digests(spark, str(tmp_path)).collect()}
    assert found == {"a.json": (True, []), "b.json": (False, ["bad_encoding"])}


def test_equal_values(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": 2, "c": 3}]}', '{"a": [1, {"c": 3, "b": 2}]}', '{"a": [{"b": 2, "c": 3}, 1]}')], "x string, y string, z string")
    x, y, z = (F.parse_json(c) for c in "xyz")
    assert tuple(df.select(contracts.same_value(x, y), contracts.same_value(x, z)).first()) == (True, False)


def test_event_history_files(spark, tmp_path):
    old = {"fingerprint": "f", "recorded_at": "2026-07-01T00:00:00+00:00", "change_signature": "s", "version_or_metric": "", "effective_date": "", "source_url": "u", "entities": []}
    bad = [old | {"fingerprint": 1}, old | {"lane": "other"}, old | {"lane": None}, old | {"entities": ["a", 1]}, old | {"recorded_at": "soon"}, old | {"resource_available": "yes"}, "text", {k: v for k, v in old.items() if k != "entities"}]
    new = old | {"lane": "global", "entities": ["a"], "geographic_scope": ["eu"], "source_type": "paper", "resource_available": True}
    (tmp_path / "h.json").write_text(json.dumps({"events": [old, *bad, new]}, indent=1))
    (tmp_path / "broken.json").write_text("{")
    rows = sorted(landed.event_history(spark, str(tmp_path)).collect(), key=lambda r: r.lane)
    assert [(r.lane, r.source_type, r.geographic_scope, r.entities, r.resource_available) for r in rows] == [("global", "paper", ["eu"], ["a"], True), ("technical", "", [], [], False)]


def test_cards(spark):
    rows = {r.run_id: r for r in registry.QUERIES["t26_cards"](spark, FOLDER).collect()}
    nothing = rows.pop("none")
    assert nothing.content.split("\n") == [cards.NOTHING, "", "已检查候选 0 条，粗筛 0 条，已核查来源 0 条。", "", cards.WHY, cards.NO_CANDIDATES]
    for r in rows.values():
        lines = r.content.split("\n")
        assert lines[:2] == [cards.TODAY, ""] and lines[3] == "" and r.content == r.content.rstrip()
        assert sum(x.startswith("[核查原文](") for x in lines) == r.n_items <= 5 and sum("🌍" in x for x in lines) == r.n_events
        for k, x in enumerate(lines):
            if x.startswith("### ") or x in (cards.EVENTS, cards.ITEMS):
                assert lines[k - 1] == lines[k + 1] == ""


def test_items_go_until_a_card_fits(spark):
    when = "2026-07-14T00:00:00Z"
    runs = spark.createDataFrame([("a", "published", "n"), ("b", "published", "n")], "run_id string, run_status string, narrative string").withColumn("generated_at", F.to_timestamp(F.lit(when)))
    zero = F.lit(0)
    runs = runs.withColumns({"candidate_count": zero, "shortlist_count": zero, "source_verified_count": zero, "rejected_count": zero, "reasons": F.array().cast("array<struct<reason: string, n: bigint>>")})
    long = {"title_zh": "t", "what_happened_zh": "中" * 400, "why_it_matters_zh": "中" * 400, "source_name": "s", "category": "companies_business"}
    events = spark.createDataFrame([("a", k, *long.values(), ["g" * 900], ["中" * 900], "https://x.org/" + "p" * 200) for k in range(1, 6)], "run_id string, rank int, " + ", ".join(f"{k} string" for k in long) + ", affected_groups_zh array<string>, key_facts array<string>, source_url string")
    events = events.withColumn("published_at", F.to_timestamp(F.lit("2026-07-11T00:00:00Z")))
    item_rows = [(run, "must_read", k, "t", "中" * 300, ["中" * 90], ["中" * 90], ["中" * 300], "verified", url, 80) for run, url in (("a", "https://x.org/"), ("b", "http://x.org/")) for k in range(1, 6)]
    items = spark.createDataFrame(item_rows, "run_id string, board string, rank int, title_zh string, concrete_change string, affected_audience array<string>, affected_area array<string>, recommended_action array<string>, verification_status string, evidence_url string, total int")
    out = {r.run_id: r for r in cards.rendered(runs, events, items).collect()}
    assert 0 < out["a"].n_items < 5 and len(out["a"].content.encode()) <= cards.CONTENT_BYTES and out["a"].content.count("· 回看") == 5
    card = json.loads(out["a"].card)
    assert card["card"]["body"]["elements"][0]["content"] == out["a"].content and card["card"]["header"]["title"]["content"].endswith("2026-07-14")
    assert out["b"].content is None and out["b"].card is None
