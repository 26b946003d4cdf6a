"""Connected components of an edge table, by alternating large and small stars
(Kiveris et al., SoCC 2014): every step is a grouping by minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def _star(directed: DataFrame) -> DataFrame:
    """Of (u, v): for each u the least of u and its v, joined to each v."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return directed.join(least.hint("merge"), "u")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b); component is the least id reachable.

    Loops and repeated edges are allowed.  The loop ends when a round changes no edge, after
    a number of rounds that grows with the logarithm of the longest path."""
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, sign = None, _signature(now)
    while sign != before:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "edges")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        joined = _star(down)
        small = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select("u", "m")).distinct()
        now = staged(small, "edges")
        before, sign = sign, _signature(now)
    return vertices.join(now.withColumnRenamed("a", "id").hint("merge"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))
