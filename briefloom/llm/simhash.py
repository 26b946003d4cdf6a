"""Near duplicates by SimHash fingerprints and tables of distances to pivots.

1. A document's fingerprint: of the XXH64 values of its shingles (repeats included), each bit that more
   than half of them have.  Fingerprints at MOST or fewer differing bits are linked; equal ones are one
   row from here on, so copies cost nothing.
2. Every distinct fingerprint gets its row of the pivot table: the Hamming distances to PIVOTS
   reference fingerprints.  By the triangle inequality two fingerprints at d bits differ by d at most in
   every coordinate, so a pair with a larger coordinate difference is discarded; survivors are verified
   by their own distance.
3. Which pairs meet.  A distance to one pivot tells random fingerprints apart badly (57 % of pairs are
   within 4), so the table alone would have to look at all pairs.  Fingerprints therefore meet in lists:
   the bits are divided into MOST + 1 parts, and a linked pair agrees in one part at least.  A list longer
   than LONG is divided again in the same way by the bits that it leaves free, until no list is
   longer; that loses no pair, is the same rule at every size, and needs no end condition but
   the bits: a list that fixes 52 of them has 4096 distinct members at most.
4. Within lists pairs are taken in the order of the first coordinate, and those that are in one component
   by then are left out; what leaves a list is at most one link a member.

Null, empty and blank texts have the fingerprint zero and are linked like any other.  A text with fewer
words than a shingle has its whole word sequence as its only shingle.  Rows are linked by their texts alone:
rows of one id may be in different components, and a null id is never the smallest of a component
unless it has no other (component_id is null then).  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import hinted, small_batches, staged
from .textscan import release

SEED, BITS, MOST = 42, 64, 4
PIVOTS = 32
#: Members of a list that is compared; longer ones are divided.  Rows that are compared at once, and pairs.
LONG, ROWS, PAIRS = 1 << (MOST * 3), 1 << 15, 1 << 20
#: Rows of a table of long lists that may be broadcast.
BROADCAST_ROWS = 200_000
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bits of each byte value, least first.
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words in lists of a bounded size, cut between words."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + PIECE)
        end = space.start() if space else len(data)
        yield data[at:end].lower().split()
        at = end


def _bit_counts(values: np.ndarray) -> np.ndarray:
    octets = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)])


def fingerprint(data: bytes, shingle: int) -> int:
    """Of one text in UTF-8; its memory is bounded by PIECE and the longest word."""
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in _word_lists(data):
        words = tail + words
        if len(words) < shingle:
            tail = words
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        values = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
        counts += _bit_counts(values)
        total += len(values)
        tail = words[len(words) - shingle + 1 :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """The fingerprint's 64 bits as a bigint."""

    def of(column: pa.Array) -> pa.Array:
        release()
        found = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in column.cast(pa.binary())), np.uint64, len(column))
        return pa.array(found.view(np.int64))

    return F.arrow_udf(of, "bigint")(text)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


@lru_cache(1 << 12)
def _divided(mask: int) -> tuple[int, ...]:
    """The masks that fix, besides the bits of a mask, one of MOST + 1 parts of the others."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * k // (MOST + 1) for k in range(MOST + 2)]
    return tuple(mask | sum(1 << b for b in free[low:high]) for low, high in zip(cuts, cuts[1:]))


def _divide(rows: DataFrame) -> DataFrame:
    """Each row of (mask, fp, table) under the masks that divide its own."""

    def masks(column: pa.Array) -> pa.Array:
        return pa.array([[_signed(m) for m in _divided(x % (1 << BITS))] for x in column.to_pylist()], pa.list_(pa.int64()))

    return rows.select("fp", "table", F.explode(F.arrow_udf(masks, "array<bigint>")(F.col("mask"))).alias("mask"))


def _short_lists(fps: DataFrame, long: int) -> DataFrame:
    """(mask, part, fp, table) of lists with 2 to `long` members that together hold every pair of (fp, table) to be looked at."""
    rows, found = _divide(fps.withColumn("mask", F.lit(0).cast("bigint"))), None
    while True:
        rows = staged(rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))), "lists")
        sizes = rows.groupBy("mask", "part").agg(F.count("*").alias("members"))
        beyond = staged(sizes.where(F.col("members") > long).select("mask", "part"), "long")
        n = beyond.count()
        short = rows.join(hinted(beyond, n, BROADCAST_ROWS), ["mask", "part"], "left_anti") if n else rows
        found = short if found is None else found.unionByName(short)
        if not n:
            return found
        rows = _divide(rows.join(hinted(beyond, n, BROADCAST_ROWS), ["mask", "part"], "left_semi"))


def linked(lists: np.ndarray, fps: np.ndarray, tables: np.ndarray, most: int) -> np.ndarray:
    """For each member the least member (by position) that it is linked with within its list, over any number of links.
    Members of a list stand together; tables: the distances to the pivots."""
    # Lists are kept apart by shifting the first coordinate.
    place = np.cumsum(np.concatenate([[0], lists[1:] != lists[:-1]])) * (BITS + most + 1) + tables[:, 0]
    order = np.argsort(place, kind="stable")
    place, fps, tables = place[order], fps[order], tables[order]
    n = len(order)
    root, first = np.arange(n), np.arange(n) + 1
    number = np.searchsorted(place, place + most, "right") - first
    upto = np.cumsum(number)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - number[low] + PAIRS, "right")))
        own = number[low:high]
        i = np.repeat(np.arange(low, high), own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
        near = root[i] != root[j]
        for k in range(1, tables.shape[1]):
            i, j = i[near], j[near]
            near = np.abs(tables[i, k] - tables[j, k]) <= most
        i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= most
        i, j = i[near], j[near]
        while len(i):
            a, b = root[i], root[j]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tolist() != root.tolist():
                root = up
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
        low = high
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _list_links(most: int):
    """Of sorted rows (mask, part, fp, table): a link of each member with the least that it is joined to in its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            mask, part, fp = (table[c].to_numpy() for c in ("mask", "part", "fp"))
            own = table["table"].chunk(0).flatten().to_numpy().reshape(len(fp), -1).astype(np.int16)
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])])
            root = linked(np.cumsum(new), fp.view(np.uint64), own, most)
            joined = np.flatnonzero(root != np.arange(len(root)))
            return pa.record_batch([pa.array(fp[joined]), pa.array(fp[root[joined]])], names=["a", "b"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) < ROWS:
                continue
            table = pa.concat_tables(held)
            mask, part = table["mask"].to_numpy(), table["part"].to_numpy()
            last = int(np.flatnonzero((mask != mask[-1]) | (part != part[-1]))[-1]) + 1 if (mask[0], part[0]) != (mask[-1], part[-1]) else 0
            held = [table.slice(last)]  # the last list may go on; it is short
            if last:
                yield links(table.slice(0, last))
        if held and sum(map(len, held)):
            yield links(pa.concat_tables(held))

    return run


def _pivot_table(fp: Column) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.xxhash64(F.lit(k)))).cast("tinyint") for k in range(PIVOTS)])


def links(fps: DataFrame, most: int = MOST, long: int = LONG) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that join whatever is joined by links of at most `most` bits (MOST at most)."""
    rows = staged(fps.select("fp", _pivot_table(F.col("fp")).alias("table")), "pivots")
    lists = _short_lists(rows, long)
    met = lists.repartition("mask", "part").sortWithinPartitions("mask", "part").select("mask", "part", "fp", "table")
    return staged(met.mapInArrow(_list_links(most), "a bigint, b bigint").distinct(), "links")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, most: int = MOST) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (least id reachable) of every row."""
    small_batches(docs.sparkSession)
    each = docs.select(F.col(id_column).cast("bigint").alias("id"), fingerprints(F.col(text), shingle).alias("fp"))
    each = staged(each, "fingerprints")
    fps = staged(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    comps = staged(components(links(fps.select("fp"), most)), "components").withColumnRenamed("id", "fp")
    own = staged(fps.join(comps.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "members")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    told = staged(own.join(least.hint("merge"), "component").select("fp", "component_id"), "told")
    found = each.join(told.hint("merge"), "fp")
    return found.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
