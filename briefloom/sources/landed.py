"""Landed files as tables: feeds, listing pages, search results, stored digests, histories and ledgers."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.urls import stable_id
from ..operators.contracts import checked
from ..operators.history import local_day

FEED_ENTRIES = 50
FEED = "title string, item array<struct<title: string, link: string, description: string, pubDate: string, updated: string, created: string>>"


def feed_date(*texts: Column) -> Column:
    """The first of the texts that is a date of a feed: a day's name may come first, a zone may be a name or an offset."""

    def one(x: Column) -> Column:
        bare = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3},\s*", "")
        parsed = [F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")]
        return F.coalesce(*parsed, F.try_to_timestamp(F.trim(x)))

    return F.coalesce(*map(one, texts))


def feed_candidates(spark: SparkSession, path: str, sources: DataFrame, now: Column, lookback_hours: int = 36) -> DataFrame:
    """Candidates of feed files; a file's folder is its source.  Of each feed the first 50 entries are looked at; entries without
    link, title or date, out of the window, or (where the source asks) without a word of AI are left out."""
    feeds = spark.read.format("xml").option("rowTag", "channel").schema(FEED).load(path)
    each = feeds.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1).alias("source"), F.posexplode(F.slice("item", 1, FEED_ENTRIES)).alias("pos", "e"))
    rows = each.select("source", "pos", F.trim("e.title").alias("title"), F.trim("e.link").alias("url"), text.cleaned_html(F.coalesce("e.description", F.lit(""))).alias("summary"), feed_date(F.col("e.pubDate"), F.col("e.updated"), F.col("e.created")).alias("published_at"))
    rows = rows.where((F.col("title") != "") & (F.col("url") != "") & F.col("published_at").isNotNull() & rules.in_window(F.col("published_at"), now, lookback_hours))
    joined = rows.join(sources, "source")
    fit = joined.where(~F.col("ai_only") | rules.looks_ai(F.col("title"), F.col("summary")))
    return fit.withColumn("candidate_id", stable_id(F.col("url")))


def feed_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source): those whose folder has a feed file that could be read."""
    feeds = spark.read.format("xml").option("rowTag", "channel").schema(FEED).load(path)
    return feeds.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1).alias("source")).distinct()


class _Listing(HTMLParser):
    """Elements of a class as items: the first link, heading text, time and paragraph in each."""

    def __init__(self, item: str) -> None:
        super().__init__(convert_charrefs=True)
        self.item, self.items, self.open, self.into = item, [], 0, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if self.open:
            self.open += tag not in ("br", "img", "input", "hr", "meta", "link")
        elif self.item in (a.get("class") or "").split() or tag == self.item:
            self.open = 1
            self.items.append({"href": "", "title": "", "date": "", "summary": ""})
        if not self.open:
            return
        now = self.items[-1]
        if tag == "a" and not now["href"]:
            now["href"] = a.get("href") or ""
        if tag == "time" and not now["date"]:
            now["date"] = a.get("datetime") or ""
        self.into = "title" if re.fullmatch("h[1-6]", tag) else "summary" if tag == "p" else self.into if tag in ("a", "b", "i", "em", "span", "strong") else ""

    def handle_endtag(self, tag: str) -> None:
        if self.open:
            self.open -= 1
            self.into = "" if re.fullmatch("h[1-6]|p", tag) else self.into

    def handle_data(self, data: str) -> None:
        if self.open and self.into:
            now = self.items[-1]
            now[self.into] = f"{now[self.into]} {data}".strip()


def listing_candidates(pages: DataFrame, item: str, now: Column, lookback_hours: int = 36) -> DataFrame:
    """Candidates of listing pages (page_url, html): one for each item element; in a page the first item with a link wins;
    links are resolved against the page."""

    def listed(column: pa.Array, bases: pa.Array) -> pa.Array:
        out = []
        for html, base in zip(column.to_pylist(), bases.to_pylist()):
            parser = _Listing(item)
            parser.feed(html or "")
            out.append([x | {"href": urljoin(base or "", x["href"])} for x in parser.items if x["href"]])
        fields = [(n, pa.string()) for n in ("href", "title", "date", "summary")]
        return pa.array(out, pa.list_(pa.struct(fields)))

    found = F.arrow_udf(listed, "array<struct<href: string, title: string, date: string, summary: string>>")(F.col("html"), F.col("page_url"))
    each = pages.select("page_url", F.posexplode(found).alias("pos", "e")).select("page_url", "pos", "e.*")
    first = each.withColumn("nth", F.row_number().over(Window.partitionBy("page_url", "href").orderBy("pos"))).where("nth = 1").drop("nth")
    dated = first.withColumn("published_at", feed_date(F.col("date"))).where(F.col("published_at").isNotNull() & (F.col("title") != "") & rules.in_window(F.col("published_at"), now, lookback_hours))
    return dated.withColumn("candidate_id", stable_id(F.col("href")))


SEARCH = "items array<struct<html_url: string, full_name: string, description: string, stargazers_count: bigint, forks_count: bigint, created_at: string>>"


def repository_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of repository search results; more stars weigh more, up to 1."""
    each = spark.read.schema(SEARCH).option("multiLine", True).json(path).select(F.explode("items").alias("r")).select("r.*")
    stars = F.coalesce("stargazers_count", F.lit(0))
    summary = F.concat(F.coalesce(F.concat("description", F.lit(" ")), F.lit("")), F.lit("★ "), F.format_number(stars, 0), F.lit(", forks "), F.format_number(F.coalesce("forks_count", F.lit(0)), 0))
    return each.select(
        stable_id(F.col("html_url")).alias("candidate_id"), F.col("full_name").alias("title"), F.col("html_url").alias("url"), summary.alias("summary"),
        F.lit(2).alias("source_tier"), F.least(F.lit(1.0), 0.82 + stars / 5000).alias("source_weight"), F.try_to_timestamp("created_at").alias("published_at"),
        F.create_map(F.lit("stars"), stars.cast("double"), F.lit("forks"), F.col("forks_count").cast("double")).alias("metrics"),
    )


def source_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The configured sources (source, tier 1-3, weight 0-2, ai_only); rows out of bounds are errors."""
    df = spark.createDataFrame(rows, "source string, source_tier int, source_weight double, ai_only boolean")
    good = F.col("source_tier").between(1, 3) & F.col("source_weight").between(0, 2) & (F.trim("source") != "")
    return df.where(F.when(good, True).otherwise(F.raise_error(F.lit("a source is out of bounds")).cast("boolean")))


def collection_health(outcomes: DataFrame) -> DataFrame:
    """attempted and succeeded of (collector, ok); when all that was tried failed, reading it is an error."""
    total = outcomes.agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"))
    dead = (F.col("attempted") > 0) & (F.col("succeeded") == 0)
    return total.where(F.when(dead, F.raise_error(F.lit("every collector failed")).cast("boolean")).otherwise(True))


def url_history(spark: SparkSession, path: str) -> DataFrame:
    """(url, recorded_at) of history files {"sent": {url: time}}; entries without a valid time are left out."""
    sent = spark.read.schema("sent map<string, string>").option("multiLine", True).json(path).select(F.explode("sent").alias("url", "at"))
    return sent.select("url", F.try_to_timestamp("at").alias("recorded_at")).where("recorded_at is not null")


def delivery_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(day, target, sent_at, run_status) of ledger files; one invalid entry makes reading an error."""
    kind = "successful_sends map<string, struct<sent_at: string, run_status: string>>"
    each = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("successful_sends").alias("key", "x"))
    rows = each.select(F.try_to_date(F.split_part("key", F.lit("|"), F.lit(1)), "yyyy-MM-dd").alias("day"), F.split_part("key", F.lit("|"), F.lit(2)).alias("target"), F.try_to_timestamp("x.sent_at").alias("sent_at"), F.col("x.run_status").alias("run_status"))
    good = F.col("day").isNotNull() & (F.col("target") != "") & F.col("sent_at").isNotNull() & F.col("run_status").isin("published", "no_qualifying_items") & (local_day(F.col("sent_at")) == F.col("day"))
    return rows.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit("invalid ledger entry")).cast("boolean")))


def latest_digest(stored: DataFrame, default: DataFrame, schema: str) -> DataFrame:
    """The newest stored digest (id, payload, updated_at) for each id of default (id, payload); where there is none
    or it cannot be read, the default."""
    last = stored.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("payload")))).where("nth = 1")
    read = last.select("id", F.from_json("payload", schema).alias("found")).where("found.schema_version is not null")
    return default.join(read, "id", "left").select("id", F.coalesce("found", F.from_json("payload", schema)).alias("digest"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Persisted digest files (path, content) with their version and violations; only good ones may be sent again."""
    return checked(spark.read.format("binaryFile").load(path).select("path", "content"), "content")


# The fields that an entry of event history must have, those that it may have, and their types.
ENTRY_TEXTS = ("fingerprint", "recorded_at", "change_signature", "version_or_metric", "effective_date", "source_url")
ENTRY_MAY = {"primary_entity": "STRING", "product_or_model": "STRING", "source_type": "STRING", "resource_available": "BOOLEAN", "scientific_verified": "BOOLEAN"}
ENTRY_LANES = ("global", "technical")


def event_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of event history files {"events": [...]}; those that are not well formed are left out, and so are files that are no JSON.
    What old entries do not tell is filled: the technical lane, no kind of source, no regions."""
    whole = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$.events", "array<variant>").alias("events"))
    v = F.col("v")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    texts = lambda name: F.try_variant_get(v, f"$.{name}", "array<string>")
    listed = lambda name: kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(texts(name), lambda x: x.isNotNull())
    good = F.try_to_timestamp(text("recorded_at")).isNotNull() & listed("entities")
    for name in ENTRY_TEXTS:
        good = good & (kind(name) == "STRING")
    for name, form in ENTRY_MAY.items():
        good = good & F.coalesce(kind(name) == form, F.lit(True))
    good = good & (kind("lane").isNull() | text("lane").isin(*ENTRY_LANES)) & (kind("geographic_scope").isNull() | listed("geographic_scope"))
    entries = whole.select(F.explode("events").alias("v")).where(F.coalesce(good, F.lit(False)))
    return entries.select(
        *[text(x).alias(x) for x in ENTRY_TEXTS if x != "recorded_at"],
        F.try_to_timestamp(text("recorded_at")).alias("recorded_at"),
        texts("entities").alias("entities"),
        *[(F.coalesce(text(x), F.lit("")) if form == "STRING" else F.coalesce(F.try_variant_get(v, f"$.{x}", "boolean"), F.lit(False))).alias(x) for x, form in ENTRY_MAY.items()],
        F.coalesce(text("lane"), F.lit("technical")).alias("lane"),
        F.coalesce(texts("geographic_scope"), F.array().cast("array<string>")).alias("geographic_scope"),
    )
