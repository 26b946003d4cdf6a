"""Quotes and the documents that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, text
from ..functions.tables import small_batches

#: Keys of quotes that may be broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 500_000
#: Words of a key; a quote has one word more at each end, which may be part of a longer one in the text.
KEY_WORDS, LEAST_WORDS = 5, 3


def validated(records: DataFrame) -> DataFrame:
    """records (claims and quotes: array<string>, source_text, source_status, covers_full_claim, verification_status) with
    n_anchors (quotes that stand in the source), covers_full_claim and verification_status after the check."""
    small_batches(records.sparkSession)
    read = records.withColumns({"_claims": evidence.profiles(F.col("claims")), "_quotes": evidence.profiles(F.col("quotes")), "_source": text.normal_body(F.coalesce("source_text", F.lit("")))})
    held = read.withColumn("_kept", evidence.kept_anchors(F.col("_quotes"), F.col("_source")))
    covered = F.col("covers_full_claim") & evidence.all_supported(F.col("_claims"), F.col("_kept"))
    out = held.withColumns({"n_anchors": F.size("_kept").cast("bigint"), "covers_full_claim": covered})
    status = evidence.checked_status(F.col("verification_status"), F.col("source_status"), F.col("_kept"), F.col("covers_full_claim"))
    return out.withColumn("verification_status", status).drop("_claims", "_quotes", "_source", "_kept")


def checked(rows: DataFrame, claims: bool) -> DataFrame:
    """rows (a record struct `r`, null where there is none, and a struct `source` with final_url, status and text) with the record held against its
    source: only anchors whose quote stands there stay, its link is where the source was found, and its status is what these anchors bear out.

    claims: whether each of its concrete changes needs an anchor that supports it (the technical lane); without one, evidence_covers_full_claim is false."""
    small_batches(rows.sparkSession)
    r, source = F.col("r"), F.col("source")
    read = rows.withColumn("_quotes", evidence.profiles(F.transform(r["evidence_anchors"], lambda a: a["quote"]))).withColumn("_text", text.normal_body(F.coalesce(source["text"], F.lit(""))))
    stands = lambda i: F.coalesce((F.get("_quotes", i)["body"] != "") & F.contains("_text", F.get("_quotes", i)["body"]), F.lit(False))
    kept = F.filter(r["evidence_anchors"], lambda a, i: stands(i))
    own = r.withField("evidence_anchors", kept).withField("source_url", source["final_url"])
    holds = F.size(kept) > 0
    if claims:
        read = read.withColumn("_claims", evidence.profiles(F.transform(r["concrete_changes"], lambda c: c["statement"])))
        covered = r["evidence_covers_full_claim"] & evidence.all_supported(F.col("_claims"), evidence.kept_anchors(F.col("_quotes"), F.col("_text")))
        own, holds = own.withField("evidence_covers_full_claim", covered), holds & covered
    status = F.when(source["status"] != "verified", source["status"]).when(holds, r["verification_status"]).otherwise("insufficient")
    return read.withColumn("r", F.when(r.isNotNull(), own.withField("verification_status", status))).drop("_quotes", "_text", "_claims")


def _windows(words: Column, n: int) -> Column:
    """The hashes of all runs of n words.  The words are bound to a variable first, so that they are split once and not for each run."""

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.slice(w, i, n)))

    return F.flatten(F.transform(F.array(words), runs))


def holdings(bodies: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each quote (item_id, quote) that a body (doc_id, body) holds; both have single spaces only.

    Quotes of fewer than LEAST_WORDS words say too little and are left out.  The others meet the bodies by the hash of some words from inside
    the quote, so only bodies that have these are searched; a long body crosses the network as keys, and once where it is met."""
    words = F.split("quote", " ")
    keyed = quotes.where(F.size(words) >= LEAST_WORDS).withColumn("n", F.when(F.size(words) >= KEY_WORDS + 2, KEY_WORDS).otherwise(1))
    keyed = keyed.select("item_id", "quote", "n", F.xxhash64(F.slice(words, F.lit(2), F.col("n"))).alias("key"))
    sizes = {r.n: r["count"] for r in keyed.groupBy("n").count().collect()}  # two rows at most
    met = None
    for n, rows in sizes.items():
        own = bodies.select("doc_id", F.explode(F.array_distinct(_windows(F.split("body", " "), n))).alias("key"))
        found = own.join(keyed.where(F.col("n") == n).select("key", "item_id").hint("broadcast" if rows <= BROADCAST_ROWS else "merge"), "key").select("doc_id", "item_id")
        met = found if met is None else met.union(found)
    if met is None:
        return bodies.join(quotes.select("item_id"), F.lit(False)).select("doc_id", "item_id")
    pairs = met.join(quotes.hint("merge"), "item_id").join(bodies.hint("merge"), "doc_id")
    return pairs.where(F.contains("body", "quote")).select("doc_id", "item_id").distinct()
