"""Reports of one event from independent hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host


def secondary_hosts(reports: DataFrame, by: list[str]) -> DataFrame:
    """Of each cluster: its reports, and how many hosts have a verified secondary one."""
    counted = (F.col("source_type") == "trusted_secondary") & (F.col("verification_status") == "verified") & (host(F.col("source_url")) != "")
    # two steps, so that a cluster with many reports is reduced where it is read
    hosts = reports.groupBy(*by, host(F.col("source_url")).alias("host")).agg(F.count("*").alias("n"), F.bool_or(counted).alias("counted"))
    return hosts.groupBy(*by).agg(F.sum("n").alias("n_reports"), F.count_if("counted").alias("secondary_hosts"))


def supporting_urls(reports: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """reports with up to `most` other URLs of their cluster, in the order of (candidate_id, source_url).
    A cluster's first `most` + 1 distinct URLs suffice for all its reports, so no cluster is collected."""
    order = ["candidate_id", "source_url"]
    first = reports.groupBy(*by, "source_url").agg(F.min("candidate_id").alias("candidate_id"))
    few = first.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= most + 1)
    lists = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("nth", "source_url"))).alias("urls"))
    joined = reports.join(lists, by, "left")
    others = F.filter(F.transform("urls", lambda x: x["source_url"]), lambda u: u != F.col("source_url"))
    return joined.withColumn("supporting_urls", F.slice(others, 1, most)).drop("urls")
