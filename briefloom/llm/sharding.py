"""Shards of near-equal bytes by histogram sort (Solomonik and Kale, IPDPS 2010).

Rows are ordered by (id, hash of the text).  Splitters of that order are found by probing: each
round counts, exactly and over all rows, the bytes and rows below every probe; the interval of each
splitter shrinks to the two probes around its target, and new probes are laid evenly into it, until
the bytes below a splitter are within the tolerance or no row is left to tell its ends
apart.  Only counts of probes reach the driver: their number is a parameter, not the data's.
Rows are then exchanged once, by the bucket between their splitters, and numbered in order.
Each shard is a row of buckets of at most `bucket_bytes` or so, so no task sorts a whole shard.

A row weighs the UTF-8 bytes of its text (null: none) plus 8.  Rows that agree in id and text are
one key and stay in one shard.  Long documents are whole, so shards differ by up to one document around each cut.  Null ids come first.  With fewer rows than shards, some
shards are empty; an empty table gives an empty result.  Columns named like the result's are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import staged

SHARDS, BUCKET_BYTES, PROBES, TOLERANCE, MOST_BUCKETS = 24, 32 << 20, 32, 0.0005, 12_000
_SIGN, _WORD = 1 << 63, 1 << 64


def key_number(high: int, low: int) -> int:
    """A key as one whole number, in the order of keys."""
    return (high + _SIGN) * _WORD + low + _SIGN


def buckets_of(high: np.ndarray, low: np.ndarray, splitters: list[int]) -> np.ndarray:
    """For each key the number of splitters that are not above it."""
    at_high = np.array([s // _WORD - _SIGN for s in splitters], np.int64)
    at_low = np.array([s % _WORD - _SIGN for s in splitters], np.int64)
    out = np.searchsorted(at_high, high, "left")
    upto = np.searchsorted(at_high, high, "right")
    tied = np.flatnonzero(upto > out)
    for h in np.unique(high[tied]) if len(tied) else ():
        rows = tied[high[tied] == h]
        a, b = out[rows[0]], upto[rows[0]]
        out[rows] = a + np.searchsorted(at_low[a:b], low[rows], "right")
    return out


def histogram(sized: DataFrame, splitters: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of the buckets between the splitters, over all rows (high, low, size)."""
    n = len(splitters) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = buckets_of(b["high"].to_numpy(), b["low"].to_numpy(), splitters)
            rows += np.bincount(at, minlength=n)
            np.add.at(size, at, b["size"].to_numpy())
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], names=["bucket", "size", "rows"])

    parts = sized.mapInArrow(counted, "bucket bigint, size bigint, rows bigint")
    size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for x in parts.groupBy("bucket").agg(F.sum("size"), F.sum("rows")).collect():  # a row for each probe at most
        size[x[0]], rows[x[0]] = x[1], x[2]
    return size, rows


def find_splitters(sized: DataFrame, n: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """n - 1 ascending keys that cut the rows (high, low, size) into n buckets of near-equal bytes."""
    ends = sized.agg(F.min("high"), F.max("high"), F.sum("size"), F.count("*")).first()
    if not ends[3]:
        return [key_number(0, 0)] * (n - 1)
    least, most, total = key_number(ends[0], -_SIGN), key_number(ends[1], _SIGN - 1) + 1, ends[2]
    targets = [total * i / n for i in range(1, n)]
    near = max(1.0, tolerance * total / n)
    low = [(least, 0, 0)] * (n - 1)  # (key, bytes below, rows below)
    high = [(most, total, ends[3])] * (n - 1)
    open_ones = set(range(n - 1))
    while open_ones:
        asked = set()
        for i in open_ones:
            a, b = low[i][0], high[i][0]
            asked |= {a + (b - a) * j // (probes + 1) for j in range(1, probes + 1)} - {a, b}
        at = sorted(asked)
        size, rows = histogram(sized, at)
        below = list(zip(at, np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()))
        for i in list(open_ones):
            inside = below[bisect_right(at, low[i][0]) : bisect_left(at, high[i][0])]
            low[i] = max([low[i], *(x for x in inside if x[1] <= targets[i])])
            high[i] = min([high[i], *(x for x in inside if x[1] > targets[i])])
            close = min(targets[i] - low[i][1], high[i][1] - targets[i]) <= near
            if close or high[i][2] - low[i][2] <= 1 or high[i][0] - low[i][0] <= 1:
                open_ones.discard(i)
    return [a[0] if t - a[1] <= b[1] - t else b[0] for a, b, t in zip(low, high, targets)]


def bucket(high: Column, low: Column, splitters: list[int]) -> Column:
    def placed(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(buckets_of(a.to_numpy(), b.to_numpy(), splitters), pa.int64())

    return F.arrow_udf(placed, "bigint")(high, low)


def sharded(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with size, shard (0 to shards - 1) and slot (0, 1, ... within the shard, in the order of ids)."""
    high = F.coalesce(F.col(id_column).cast("bigint"), F.lit(-_SIGN))
    low = F.xxhash64(F.coalesce(text, F.lit("")))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    sized = staged(docs.select(high.alias("high"), low.alias("low"), size.alias("size")), "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    each = max(1, min(MOST_BUCKETS // shards, -(-total // (shards * bucket_bytes))))
    splitters = find_splitters(sized, shards * each)
    rows = histogram(sized, splitters)[1]
    before = [int(rows[k - k % each : k].sum()) for k in range(shards * each)]
    held = docs.drop("size", "shard", "slot")
    held = held.select(F.struct(*held.columns).alias("doc"), high.alias("high"), low.alias("low"), size.alias("size"))
    dealt = held.withColumn("bucket", bucket(F.col("high"), F.col("low"), splitters)).repartition("bucket")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("high", "low")) - 1
    base = F.element_at(F.array(*map(F.lit, before)), F.col("bucket").cast("int") + 1) if each * shards <= 1000 else lookup(F.col("bucket"), before)
    return dealt.select("doc.*", "size", F.floor(F.col("bucket") / each).cast("int").alias("shard"), (place + base).cast("bigint").alias("slot"))


def lookup(at: Column, values: list[int]) -> Column:
    table = np.array(values, np.int64)
    return F.arrow_udf(lambda x: pa.array(table[x.to_numpy()]), "bigint")(at)


def op5_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
