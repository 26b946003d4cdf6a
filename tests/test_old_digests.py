"""Digests of version 2 as they are written, and how the query deals their lines."""

import json

from briefloom.operators import contracts
from briefloom.plans import queries


def test_old_digests_as_written_meet_the_rules_of_parsed_ones(spark):
    item = {"original_title": "part 1", "title_en": "", "summary_en": "", "title_zh": "", "summary_zh": "", "url": "https://x.com/1", "source": "s", "published_at": "2026-07-14T00:00:00Z", "category": "agents", "extra_categories": [], "importance": 5}
    good = {
        "schema_version": 2, "run_status": "published", "generated_at": "2026-07-14T00:00:00Z", "candidate_count": 20, "source_count": 1, "latest_published_at": None, "fresh_count_24h": 0, "lookback_hours": 36, "fallback_used": False,
        "items": [item],
    }
    cases = {
        "": good, "bad_item": good | {"items": [item | {"importance": 101}]}, "bad_counts": good | {"candidate_count": 0}, "bad_status": good | {"run_status": "no_qualifying_items"}, "bad_shape": good | {"generated_at": "today"},
        "bad_counts,bad_item": good | {"items": [item] * 11, "candidate_count": 10}, "bad_shape,bad_item,bad_status": good | {"fallback_used": None, "items": [item | {"url": "http://x"}], "run_status": None},
    }
    rows = [(codes, kind, json.dumps(d, separators=(",", ":")).replace(",", kind, 1)) for codes, d in cases.items() for kind in (",", ", ")]
    got = contracts.checked(spark.createDataFrame(rows, "codes string, kind string, payload string")).collect()
    assert len(got) == len(rows) and {(r.codes, r.kind): (",".join(r.violations), r.version) for r in got} == {(codes, kind): (codes, 2) for codes, kind, _ in rows}


def test_lines_are_dealt_before_they_become_items(spark):
    plan = queries.v2_old_digests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_collect_list") < plan.index("Exchange")
