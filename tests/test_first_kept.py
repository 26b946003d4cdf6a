"""The first kept ones of an order without the dedupe of all candidates."""

import random

import pytest
from pyspark.sql import functions as F

from briefloom.operators import dedupe, ranking
from briefloom.plans import daily
from briefloom.sources.adapters import NOW
from tests.test_dedupe import plain_dedupe

KIND = "run_id string, candidate_id string, url string, title string, source_tier int, source_weight double, stars bigint"


def candidates(rng, run, n, n_bases):
    words = "alpha beta gamma delta model engine release agent paper chip market note stone river copper a x".split()
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 8, 12]))] for _ in range(n_bases)]
    out = []
    for i in range(n):
        title = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(title))
            title[k] = title[k] + rng.choice(["", "s", "z"]) if rng.random() < 0.7 else rng.choice(words)
        out.append((run, f"{run}-{i:03d}", f"https://h.x/{rng.randrange(n)}", " ".join(title) if rng.random() < 0.95 else "", rng.randint(1, 3), rng.choice([0.5, 1.0]), rng.randrange(3)))
    return out


def test_first_kept_are_those_of_the_whole_dedupe(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "BLOCK", 8)  # several blocks of a class
    rng = random.Random(5)
    runs = {"wide": candidates(rng, "wide", 120, 60), "few": candidates(rng, "few", 6, 3)}
    # its first forty are copies, all of them of a better one at the end
    copies = candidates(rng, "copies", 60, 40)
    runs["copies"] = [(*r[:2], f"https://c.x/{i}", "one title of them all here" + " s" * (i % 2), 2, *r[5:]) if i < 40 else r for i, r in enumerate(copies)]
    runs["copies"][-1] = (*runs["copies"][-1][:3], "one title of them all here", 1, 9.0, 9)
    df = spark.createDataFrame([r for rows in runs.values() for r in rows], KIND)
    first = lambda c, n: ranking.top(c, n, ["run_id"], ["candidate_id"])
    best = lambda c, n: ranking.top(c.where("stars = 2"), n, ["run_id"], [F.col("candidate_id").desc()])
    got = {(r.run_id, r.candidate_id) for r in dedupe.first_kept(df.repartition(3), (8, first), (4, best)).collect()}
    for run, rows in runs.items():
        kept = plain_dedupe(rows)
        own = {x for x in got if x[0] == run}
        assert own <= kept
        assert set(sorted(kept)[:8]) <= own and set(sorted((x for x in kept if next(r for r in rows if r[1] == x[1])[6] == 2), reverse=True)[:4]) <= own


def test_a_run_compares_no_titles_with_all(spark, monkeypatch):
    """What a run looks at is as after a dedupe of all its candidates, which it does not make."""
    rng = random.Random(6)
    rows = [(*r, f"source{i % 3}", 'a text', i % 30 if run == "near" else 40 + i % 100, ["technical"]) for run in ("near", "far") for i, r in enumerate(candidates(rng, run, 150, 60))]
    df = spark.createDataFrame(rows, KIND + ", source string, summary string, age int, lane_hints array<string>")
    now = F.lit(NOW).cast("timestamp")
    df = df.withColumn("published_at", now - F.make_dt_interval(hours="age")).drop("age").withColumn("title", F.when(F.col("title") != "", F.concat("title", F.lit(" API v2"))).otherwise(""))
    sent = spark.createDataFrame([], "run_id string, url string, recorded_at timestamp, run string")
    kept = dedupe.hard_dedupe(df)
    near, far = kept.where("run_id = 'near'"), kept.where("run_id = 'far'")
    expected = {(r.run_id, r.candidate_id) for part in (ranking.newest(near), ranking.merged_fallback(ranking.technical_shortlist(far, now), far)) for r in part.collect()}
    monkeypatch.setattr(dedupe, "similar_titles", lambda titles: pytest.fail("all titles are compared with all"))
    got, enough = daily.prepared(df, sent, now)
    assert {(r.run_id, r.candidate_id) for r in got.collect()} == expected and [r.run_id for r in enough.collect()] == ["near"]
