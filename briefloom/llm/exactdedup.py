"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

1. Each text is normalised (A-Z to a-z, nothing else) and cut into chunks where its own content
   says so: after a white-space character that follows one of a few letters, at least 1024
   characters after the last cut, or after 16384 where no such place comes.  Cuts depend on
   nothing before the last one, so passages that documents share fall into the same chunks.
2. Chunks are deduplicated: each distinct chunk crosses the network about once, under its
   fingerprint (64-bit hash and length).  Contents that meet under one fingerprint are compared as
   they are; where they differ, each gets a number of its own.  The identifier (fingerprint,
   number) therefore stands for exactly one content.
3. A document is then the ordered list of its chunks' identifiers, and equal texts are equal
   lists: grouping moves identifiers, not texts.

Null counts as the empty text, whose list is empty; all such documents are equal.  Of equal
documents the one with the largest id stays; rows repeated with that same id all stay as one
document would (they share keep_id).  Rows with one id and different texts are judged each by its own text.
A null id is less than all others; where equal documents have no other ids, all of them stay.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import hinted, staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CUT = r"(?s).{1024,16384}?(?<=[aeinst][.,;:!?]?\s)|.{1,16384}"
#: Fingerprints with more than one content that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def normalised(text: Column) -> Column:
    """A-Z to a-z; null to empty.  lower() does that alone where all is ASCII, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def fingerprint(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("h"), F.octet_length(chunk).alias("n"))


def clashes(texts: DataFrame) -> tuple[DataFrame, int]:
    """(h, n, chunk, number) of the chunks whose fingerprint some other chunk has too, and their count."""
    each = texts.select(F.explode(chunks(F.col("body"))).alias("chunk"))
    distinct = each.groupBy(F.xxhash64("chunk").alias("h"), F.octet_length("chunk").alias("n"), "chunk").count()
    shared = staged(distinct.groupBy("h", "n").count().where("count > 1").select("h", "n"), "clashes")
    rows = shared.count()
    if rows:
        found = distinct.select("h", "n", "chunk").join(hinted(shared, rows, BROADCAST_ROWS), ["h", "n"], "left_semi")
        contents = found.groupBy("h", "n").agg(F.array_sort(F.collect_list("chunk")).alias("contents"))
        shared = staged(contents.select("h", "n", F.posexplode("contents").alias("number", "chunk")), "clashes")
        rows = shared.count()
    return shared, rows


def recipes(texts: DataFrame, clashing: DataFrame, rows: int) -> DataFrame:
    """texts (id, body, sha) with each body replaced by its recipe: a list of (h, n, number)."""
    if rows == 0:
        ids = F.transform(chunks(F.col("body")), lambda c: F.struct(F.xxhash64(c).alias("h"), F.octet_length(c).alias("n"), F.lit(0).alias("number")))
        return texts.select("id", "sha", ids.alias("recipe"))
    each = texts.select("id", "sha", F.posexplode_outer(chunks(F.col("body"))).alias("pos", "chunk"))
    each = each.withColumn("h", F.xxhash64("chunk")).withColumn("n", F.octet_length("chunk"))
    named = each.join(hinted(clashing, rows, BROADCAST_ROWS), ["h", "n", "chunk"], "left").select(
        "id", "sha", "pos", F.when(F.col("pos").isNotNull(), F.struct("pos", "h", "n", F.coalesce("number", F.lit(0)).alias("number"))).alias("part")
    )
    listed = named.groupBy("id", "sha").agg(F.array_sort(F.collect_set("part")).alias("parts"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"))
    ids = F.transform("parts", lambda p: F.struct(p["h"].alias("h"), p["n"].alias("n"), p["number"].alias("number")))
    return listed.select("id", "sha", ids.alias("recipe"), F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).drop("col")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every document."""
    texts = docs.select(F.col(id_column).alias("id"), normalised(F.col(text)).alias("body")).withColumn("sha", F.sha2("body", 256))
    listed = staged(recipes(texts, *clashes(texts)), "recipes")
    groups = listed.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    several = groups.where(F.col("group_size") > 1).hint("merge")
    joined = listed.join(several, "recipe", "left")
    keep = F.coalesce("keep_id", "id")
    return joined.select(
        F.col("id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text another document with a larger id has as well."""
    # an id may stand at several texts, of which only one is a copy
    groups = exact_groups(docs, id_column, text).where(~F.col("kept"))
    gone = staged(groups.select(F.col(id_column).alias("_gone"), F.xxhash64("text_sha256").alias("_text")).distinct(), "copies")
    same = docs[id_column].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.sha2(normalised(docs[text]), 256)) == gone["_text"])
    return docs.join(hinted(gone, gone.count(), 1_000_000), same, "left_anti")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""
