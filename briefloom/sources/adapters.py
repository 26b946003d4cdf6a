"""Tables of candidates, events, clusters and scored items derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time of a run over these tables.
NOW = "2026-07-14 12:00:00"
#: The day on which events are current; earlier ones are history.
EVENT_DAY = "2024-01-24"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each document; a run for each language."""
    d = table(spark, sf_dir, "documents")
    first = F.substring(F.split("text", "\n", 2)[0], 1, 280)
    title = F.concat(
        first,
        F.when(F.col("doc_id") % 3 != 2, F.concat(F.lit(" API v"), (F.col("doc_id") % 5).cast("string"))).otherwise(""),
        F.when(F.col("doc_id") % 7 == 0, " may").otherwise(""),
    )
    return d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("candidate_id"),
        F.col("lang").alias("run_id"),
        title.alias("title"),
        F.substring("text", 1, 2400).alias("summary"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        "source",
        (1 + F.col("doc_id") % 3).cast("int").alias("source_tier"),
        F.round(0.70 + 0.05 * (F.col("doc_id") % 7), 2).alias("source_weight"),
        (now() - F.make_dt_interval(hours=(F.col("doc_id") % 240).cast("int"))).alias("published_at"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("global"))).otherwise(F.array(F.lit("technical"))).alias("lane_hints"),
        (F.col("doc_id") * 37 % 5000).alias("stars"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_records(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream; `now` is the end of an event's day, when its run is."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, since a stream takes no single file
    return as_event_records(e).withColumn("now", F.date_trunc("day", "recorded_at") + F.expr("INTERVAL 86399 SECONDS"))


def as_event_records(e: DataFrame) -> DataFrame:
    """The event stream as classified records: a user is a company, an event type its product and change."""
    version = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    company = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return e.select(
        "event_id",
        F.lit("technical").alias("lane"),
        company.alias("primary_entity"),
        F.col("event_type").alias("product_or_model"),
        F.col("event_type").alias("change_signature"),
        version.alias("version_or_metric"),
        F.lit("").alias("effective_date"),
        F.array_sort(F.array_distinct(F.array(company, "event_type"))).alias("entities"),
        (F.col("event_id") % 5 == 0).alias("resource_available"),
        (F.col("event_id") % 7 == 0).alias("scientific_verified"),
        F.concat_ws("|", company, "event_type", "event_type", version, F.lit("")).alias("fingerprint"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one event from many hosts: a part is an event, a supplier a host."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_partkey").alias("fingerprint"),
        F.concat(F.lit("https://host"), F.col("l_suppkey").cast("string"), F.lit(".example.com/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("source_url"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("candidate_id"),
        F.when(F.col("l_linestatus") == "F", "verified").otherwise("insufficient").alias("verification_status"),
        F.when(F.col("l_returnflag") != "R", "trusted_secondary").otherwise("official_announcement").alias("source_type"),
    )


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records: an order is an item of the run of its priority, a customer its event, a nation its company."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    part = lambda m, n, least=0: (least + k * m % n).cast("int")
    parts = [part(7, 26), part(11, 21), part(13, 16), part(5, 16), part(3, 16), part(17, 11), (0 - k % 3 * 10).cast("int")]
    return o.select(
        k.alias("item"),
        F.col("o_orderpriority").alias("run_id"),
        F.col("o_custkey").alias("fingerprint"),
        F.col("c_nationkey").alias("company"),
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("category"),
        *[p.alias(n) for n, p in zip(("relevance", "actionability", "specificity", "information_gain", "evidence_quality", "time_sensitivity", "penalties"), parts)],
        F.greatest(F.lit(0), sum(parts, F.lit(0))).cast("int").alias("total"),
        (k % 4 != 0).alias("eligible_main"),
        (k % 6 != 1).alias("eligible_watch"),
        (k % 3 != 0).alias("resource_available"),
        (k % 20).cast("int").alias("action_horizon_days"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("published"),
    )
