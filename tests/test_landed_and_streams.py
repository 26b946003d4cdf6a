import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from briefloom.operators import history
from briefloom.sources import landed
from briefloom.streaming import state

def now():
    return F.lit("2026-07-14 12:00:00").cast("timestamp")


def test_feeds(spark, tmp_path):
    item = "<item><title>{t}</title><link>{u}</link><description>&lt;b&gt;an llm&lt;/b&gt;</description><pubDate>{d}</pubDate></item>"
    good = [item.format(t=f"Title {i}", u=f"https://a.b/{i}", d="Tue, 14 Jul 2026 10:00:00 GMT") for i in range(60)]
    odd = [item.format(t="", u="https://a.b/x", d="Tue, 14 Jul 2026 10:00:00 GMT"), item.format(t="undated", u="https://a.b/y", d="soon"), item.format(t="old", u="https://a.b/z", d="Mon, 1 Jun 2026 10:00:00 +0200")]
    (tmp_path / "feed1").mkdir()
    (tmp_path / "feed1" / "f.xml").write_text("<rss><channel><title>F</title>" + "".join(odd + good) + "</channel></rss>")
    sources = landed.source_table(spark, [("feed1", 1, 1.0, True)])
    rows = landed.feed_candidates(spark, str(tmp_path / "*"), sources, now()).collect()
    assert len(rows) == 47 and rows[0].summary == "an llm" and len(rows[0].candidate_id) == 16
    with pytest.raises(PySparkException):
        landed.source_table(spark, [("x", 9, 1.0, True)]).collect()


def test_listing_pages(spark):
    html = '<div class="post x"><a href="/a?utm_source=1"><h2>One</h2></a><time datetime="2026-07-14T08:00:00Z"></time><p>sum <b>bold</b></p></div><div class="post"><a href="/a?utm_source=1"><h2>Twice</h2></a><time datetime="2026-07-14T08:00:00Z"></div>'
    df = spark.createDataFrame([("https://s.x/list", html), ("https://s.x/none", None)], "page_url string, html string")
    rows = landed.listing_candidates(df, "post", now()).collect()
    assert [(r.href, r.title, r.summary) for r in rows] == [("https://s.x/a?utm_source=1", "One", "sum bold")]


def test_repositories_and_histories(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"items": [{"html_url": "https://g.x/a/b", "full_name": "a/b", "description": "d", "stargazers_count": 1234, "forks_count": 5, "created_at": "2026-07-01T00:00:00Z"}]}))
    r = landed.repository_candidates(spark, str(tmp_path / "s.json")).first()
    assert r.summary == "d ★ 1,234, forks 5" and r.source_weight == 1.0 and r.metrics["stars"] == 1234
    (tmp_path / "h.json").write_text(json.dumps({"sent": {"https://a.b/": "2026-07-01T00:00:00Z", "https://a.c/": "bad"}}))
    assert landed.url_history(spark, str(tmp_path / "h.json")).count() == 1
    (tmp_path / "l.json").write_text(json.dumps({"successful_sends": {"2026-07-14|t": {"sent_at": "2026-07-14T01:00:00Z", "run_status": "published"}}}))
    assert landed.delivery_ledger(spark, str(tmp_path / "l.json")).count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"successful_sends": {"2026-07-14|t": {"sent_at": "never", "run_status": "published"}}}))
    with pytest.raises(PySparkException):
        landed.delivery_ledger(spark, str(tmp_path / "m.json")).collect()


def test_url_memory_ends_after_30_days(spark):
    sent = spark.createDataFrame([("https://a.b/1/?utm_x=1", "2026-06-14 12:00:01"), ("https://a.b/2", "2026-06-14 12:00:00"), ("https://a.b/3", "2026-06-14 11:59:59")], "url string, at string").select("url", F.col("at").cast("timestamp").alias("recorded_at"))
    new = spark.createDataFrame([("https://a.b/1",), ("https://a.b/2",), ("https://a.b/3",), ("https://a.b/4",)], "url string")
    assert sorted(r.url[-1] for r in history.unsent(new, sent, now()).collect()) == ["3", "4"]


def event(i, company, product, change, version, at, resource=False, lane="technical"):
    return (i, lane, company, product, change, version, "", sorted({company, product}), resource, False, "|".join((company, product, change, version, "")), at)


KIND = "event_id bigint, lane string, primary_entity string, product_or_model string, change_signature string, version_or_metric string, effective_date string, entities array<string>, resource_available boolean, scientific_verified boolean, fingerprint string, recorded_at string"


def events(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))


def test_classification(spark):
    past = events(spark, [event(1, "acme", "gizmo", "launch", "1", "2026-07-10 00:00:00"), event(2, "acme", "model", "price", "1", "2026-07-12 00:00:00"), event(3, "old", "x", "launch", "1", "2026-07-01 00:00:00")])
    new = events(
        spark,
        [
            event(10, "acme", "gizmo", "launch", "1", "2026-07-14 00:00:00"),
            event(11, "acme", "gizmo", "launch", "1", "2026-07-14 00:00:00", resource=True),
            event(12, "acme", "gizmo", "launch", "2", "2026-07-14 00:00:00"),
            event(13, "acme", "model", "price", "2", "2026-07-14 00:00:00"),
            event(14, "other", "gizmo", "launch", "1", "2026-07-14 00:00:00"),
            event(15, "old", "x", "launch", "1", "2026-07-14 00:00:00"),
        ],
    )
    got = {r.event_id: r.dup_status for r in history.classified(new, past, now()).collect()}
    assert got == {10: "duplicate", 11: "material_update", 12: "material_update", 13: "unique", 14: "unique", 15: "unique"}


def test_first_seen(spark, tmp_path):
    rows = [event(i, f"c{i % 3}", "gizmo", "launch", str(i % 2), f"2026-07-{10 + i // 6:02d} 0{i % 6}:00:00") for i in range(24)]
    for k in range(3):
        events(spark, rows[8 * k : 8 * k + 8]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    schema = events(spark, rows).schema
    first = state.event_first_seen(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), ["fingerprint"], "recorded_at", "30 days")
    state.run_available(first, lambda df, n: df.write.parquet(str(tmp_path / f"first{n}")), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "first0")).count() == 6


def test_delivery_is_made_once(spark, tmp_path):
    kind = "target string, sent_at timestamp, run_status string"
    for k in range(2):
        spark.sql("SELECT 'a' AS target, TIMESTAMP '2026-07-14 01:00:00' AS sent_at, 'published' AS run_status").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    sent = []
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    state.run_available(stream, state.deliver_batches(spark, str(tmp_path / "out"), lambda df: sent.append(df.count())), str(tmp_path / "c"))
    assert sum(sent) == 1 and state.delivered_once(spark, str(tmp_path / "out")).count() == 1


def test_histories_follow_the_ledger(spark, tmp_path):
    """What was sent is written down: first the delivery, then its URLs, then its events; a batch that crashed between is repeated without loss."""
    kind = "target string, sent_at string, run_status string, url string, fingerprint string, primary_entity string, product_or_model string, change_signature string, version_or_metric string, effective_date string, event_entities array<string>, source_url string"
    row = lambda target, day, n: (target, f"2026-07-{day} 01:00:00", "published", f"https://a.x/{n}", f"f{n}", "Acme", "Gizmo", "launch", str(n), "", ["Acme"], f"https://a.x/{n}")
    batches = [[row("a", 14, 1), row("a", 14, 2)], [row("a", 14, 3), row("b", 14, 4)], [row("a", 15, 5)]]
    made = [spark.createDataFrame(rows, kind).withColumn("sent_at", F.col("sent_at").cast("timestamp")) for rows in batches]
    histories = {"urls": lambda due: due.select("url", F.col("sent_at").alias("recorded_at")), "events": lambda due: history.snapshots(due, "technical", F.col("sent_at"))}
    sent = []
    write = state.deliver_batches(spark, str(tmp_path), lambda due: sent.append(sorted(r.url[-1] for r in due.collect())), histories)
    broken = state.deliver_batches(spark, str(tmp_path), lambda due: None, histories | {"events": lambda due: due.select(F.raise_error(F.lit("down")).alias("x"))})
    write(made[0], 0)
    with pytest.raises(PySparkException):
        broken(made[1], 1)
    for n in (1, 2, 1):
        write(made[n], n)
    assert sent == [["1", "2"], ["4"], ["5"], ["4"]]
    assert sorted((str(r.day), r.target) for r in state.delivered_once(spark, str(tmp_path)).collect()) == [("2026-07-14", "a"), ("2026-07-14", "b"), ("2026-07-15", "a")]
    read = lambda name: spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    assert sorted(r.url[-1] for r in read("urls").collect()) == ["1", "2", "4", "5"]
    assert sorted((r.fingerprint, r.lane, r.primary_entity) for r in read("events").collect()) == [(f"f{n}", "technical", "acme") for n in (1, 2, 4, 5)]


def test_pages_seen_first(spark, tmp_path):
    """Forms of one link count once within 30 days, whatever batch they come in."""
    for k, urls in enumerate((["https://a.x/1?utm_source=q", "https://A.x/1/"], ["https://a.x/1#top", "https://a.x/2"])):
        spark.createDataFrame([(u,) for u in urls], "url string").withColumn("recorded_at", F.lit(f"2026-07-1{k} 00:00:00").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("url string, recorded_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    state.run_available(state.url_first_seen(stream), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / str(n))), str(tmp_path / "c"))
    assert sorted(r.canonical_url for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect()) == ["https://a.x/1", "https://a.x/2"]
