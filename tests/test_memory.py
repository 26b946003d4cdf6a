"""Event memory: classification by an inverted index, and the same as keyed state of a stream."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from briefloom.operators import history
from briefloom.streaming import memory, state

GENERAL = {"ai", "api", "sdk", "model", "agent", "release", "update"}
KIND = "event_id bigint, lane string, primary_entity string, product_or_model string, change_signature string, version_or_metric string, effective_date string, entities array<string>, resource_available boolean, scientific_verified boolean, fingerprint string, recorded_at timestamp"
START = datetime(2026, 7, 1, 4, tzinfo=timezone.utc)


def made(rng, i, at):
    company = rng.choice(["acme", "bolt", "core", ""])
    product = rng.choice(["gizmo", "model", "", "lamp", "kit"])
    change, version = rng.choice(["launch", "price"]), rng.choice("123")
    about = sorted({x for x in (company, product, *rng.sample(["north", "south", "agent", "east", "west"], rng.randrange(4))) if x})
    return (i, "technical", company, product, change, version, rng.choice(["", "2026-08-01"]), about, rng.random() < 0.3, rng.random() < 0.2, "|".join((company, product, change, version)), at)


def plain(records, past, now):
    """By looking through the whole history for each record."""
    day = lambda t: (t + timedelta(hours=8)).date()
    active = [e for e in past if 0 <= (day(now) - day(e[11])).days <= 7]
    latest = {}
    for e in sorted(active, key=lambda e: (e[11], e[0])):
        latest[e[10]] = e
    out = {}
    for r in records:
        newly = lambda e, r=r: (r[8] and not e[8]) or (r[9] and not e[9])
        same = latest.get(r[10])
        if same:
            out[r[0]] = ("material_update", r[10]) if newly(same) else ("duplicate", None)
            continue
        near = None
        for e in sorted(latest.values(), key=lambda e: (e[11], e[10]), reverse=True):
            product = r[3] and r[3] == e[3] and r[3] not in GENERAL
            if r[2] and e[2] == r[2] and e[4] == r[4] and (product or (set(r[7]) & set(e[7])) - GENERAL - {r[2], ""}):
                near = e
                break
        if near:
            out[r[0]] = ("material_update" if r[5] != near[5] or r[6] != near[6] or newly(near) else "minor_update", near[10])
        else:
            out[r[0]] = ("unique", None)
    return out


def test_index_equals_looking_through(spark):
    rng = random.Random(2)
    now = START + timedelta(days=9)
    past = [made(rng, i, START + timedelta(hours=rng.randrange(300))) for i in range(120)]
    new = [made(rng, 1000 + i, now) for i in range(80)]
    got = history.classified(spark.createDataFrame(new, KIND), spark.createDataFrame(past, KIND).repartition(3), F.lit(now))
    assert {r.event_id: (r.dup_status, r.update_of) for r in got.collect()} == plain(new, past, now)
    assert len({s for s, _ in plain(new, past, now).values()}) == 4


def test_company_with_many_entries_stays_small(spark):
    """100,000 entries and 2,000 records of one company: the join that finds near entries makes a row for each token of a record."""
    own = ["'technical' AS lane", "'acme' AS primary_entity", "'launch' AS change_signature", "'1' AS version_or_metric", "'' AS effective_date", "array('acme', 'north') AS entities", "false AS resource_available", "false AS scientific_verified"]
    past = spark.range(100_000).selectExpr("id AS event_id", "concat('p', id) AS product_or_model", *own, "concat('f', id) AS fingerprint", "TIMESTAMP '2026-07-08 00:00:00' + make_dt_interval(0, 0, 0, id / 10) AS recorded_at")
    new = spark.range(2_000).selectExpr("id + 1000000 AS event_id", "concat('q', id) AS product_or_model", *own, "concat('g', id) AS fingerprint", "TIMESTAMP '2026-07-09 23:00:00' AS recorded_at")
    got = history.classified(new, past, F.lit("2026-07-09 23:00:00").cast("timestamp"))
    assert {(r.dup_status, r.update_of) for r in got.collect()} == {("minor_update", "f99999")}
    latest = past.groupBy(*history._ABOUT, "fingerprint").agg(F.max_by(F.struct("recorded_at", "fingerprint", *history.ENTRY), "recorded_at").alias("old"))
    tokens = lambda at: history.technical_tokens(F.col(f"{at}product_or_model"), F.col(f"{at}entities"), F.col("primary_entity"))
    assert history._nearest(new, latest, "event_id", tokens).count() == 2_000


def test_global_lane(spark):
    kind = KIND + ", geographic_scope array<string>, source_type string"
    row = lambda i, company, change, version, about, scope, source, fp: (i, "global", company, "", change, version, "", about, False, False, fp, START, scope, source)
    past = [row(1, "acme", "ban", "1", ["acme", "law"], ["eu"], "trusted_secondary", "a"), row(2, "bolt", "deal", "1", ["bolt"], ["us"], "official_announcement", "b")]
    new = [
        row(10, "acme", "ban", "1", ["acme"], ["eu"], "trusted_secondary", "a"), row(11, "acme", "ban", "1", ["acme"], ["eu", "us"], "trusted_secondary", "a"),
        row(12, "acme", "ban", "1", ["acme"], ["eu"], "paper", "a"), row(13, "acme", "ban", "1", ["law"], ["eu"], "trusted_secondary", "c"),
        row(14, "acme", "ban", "2", ["law"], ["eu"], "trusted_secondary", "d"), row(15, "bolt", "ban", "1", ["bolt"], [], "paper", "e"), row(16, "bolt", "deal", "1", ["bolt"], ["us"], "paper", "f"),
    ]
    got = history.classified_global(spark.createDataFrame(new, kind), spark.createDataFrame(past, kind), F.lit(START))
    assert {r.event_id: (r.dup_status, r.update_of) for r in got.collect()} == {
        10: ("duplicate", None), 11: ("material_update", "a"), 12: ("material_update", "a"), 13: ("minor_update", "a"), 14: ("material_update", "a"), 15: ("unique", None), 16: ("minor_update", "b"),
    }


def test_stream_equals_days(spark, tmp_path):
    """Twenty runs in ten batches, with what the state holds at the end."""
    rng = random.Random(8)
    runs = [[made(rng, 100 * d + i, START + timedelta(days=d, minutes=i)) for i in range(rng.randrange(1, 25))] for d in range(20)]
    for d, run in enumerate(runs):
        now = START + timedelta(days=d, hours=3)
        spark.createDataFrame(run, KIND).withColumn("now", F.lit(now)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{d:02d}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "00")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    with memory.keyed_state(spark):
        out = memory.classified_stream(stream)
        state.run_available(out, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"{n:03d}")), str(tmp_path / "c"))
        entries = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "entries").load().collect()
    got = {r.event_id: (r.dup_status, r.update_of) for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect()}
    want, past = {}, []
    for d, run in enumerate(runs):
        want |= plain(run, past, START + timedelta(days=d, hours=3))
        past += run
    assert got == want and len({s for s, _ in got.values()}) == 4
    # What is beyond the days that count, and the day that rows may be late, is gone.
    last = max(e[11] for e in past)
    assert 0 < len(entries) <= len({(e[2], e[4], e[10]) for e in past if (last - e[11]).days <= 7 + 4})
    assert len(entries) < len({e[10] for e in past})
