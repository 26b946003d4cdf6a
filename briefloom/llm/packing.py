"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk supersteps.

Lengths are whole numbers up to the capacity, so documents of one length, and gaps of one size,
form a class, and there are no more classes than the capacity, whatever the number of rows.

* Range sort: every piece gets its rank within its length class by a distributed sort (classes
  are cut into slices, so that a class with a third of all rows is still many small sorts).
* Superstep: the longest class not yet placed sweeps the gap classes upwards from its own length
  (its successors).  Conflicts are resolved by rank: ranks a..b of the class take the sequences
  s..t of the gap class in order, as many to each as fit; gaps are updated; the rest of
  the class opens new sequences.  Then the next class follows, until all are placed.
* Each superstep is a handful of rank ranges.  They are the only thing that is held in one place:
  a table bounded by the capacity, not by the corpus.  All pieces are then placed in parallel
  by looking their rank up in it.

The result is exactly that of the sequential best-fit-decreasing algorithm over all pieces.
Null texts count as empty and hold only the end id.  Repeated rows are placed each on its own.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import small_batches, staged
from .tokens import pieces

CAPACITY, END_ID = 4096, 1
#: Rows of one length class that are sorted together.
SLICE_ROWS = 20_000
_RANK_BITS = 44


def supersteps(classes: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset) that place every piece.

    classes holds how many pieces have each length. A row holds until the next of its length."""
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: ranges (first sequence, number)
    sizes: list[int] = []
    opened = 0

    def leave(size: int, first: int, number: int) -> None:
        if size and number:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, number))

    for length in sorted(classes, reverse=True):
        left, rank = classes[length], 0
        changed: list[tuple[int, int, int]] = []

        def fill(first: int, number: int, size: int) -> None:
            """Puts what is left into the sequences of a range, each with a gap of the given size."""
            nonlocal left, rank
            fit = size // length
            taken = min(left, fit * number)
            full, rest = divmod(taken, fit)
            plan.append((length, rank, first, fit, capacity - size))
            left, rank = left - taken, rank + taken
            changed.append((size - fit * length, first, full))
            if rest:
                changed.append((size - rest * length, first + full, 1))
            changed.append((size, first + full + bool(rest), number - full - bool(rest)))

        at = bisect_left(sizes, length)
        while left and at < len(sizes):
            size = sizes.pop(at)
            for first, number in gaps.pop(size):
                if left:
                    fill(first, number, size)
                else:
                    changed.append((size, first, number))
        if left:
            number = -(-left // (capacity // length))
            fill(opened, number, capacity)
            opened += number
        for size, first, number in changed:
            leave(size, first, number)
    plan.sort()
    return np.array(plan, np.int64).reshape(-1, 5)


def ranked(table: DataFrame, length: str, order: list[str]) -> DataFrame:
    """table with `rank`: the row's place among those of its length, by the given order of hashes and columns."""
    rows = table.count()
    slices = max(1, -(-rows // SLICE_ROWS))
    cut = table.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = cut.groupBy(length, "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(length, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(length, "slice").orderBy(*order))
    return cut.withColumn("own", own).join(base.hint("merge"), [length, "slice"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("slice", "own", "base")


def looked_up(length: Column, rank: Column, plan: np.ndarray) -> Column:
    """Where the plan puts the piece of this length and rank."""
    keys = (plan[:, 0] << _RANK_BITS) | plan[:, 1]

    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        row = plan[np.searchsorted(keys, (size << _RANK_BITS) | rank, "right") - 1]
        nth = rank - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * size)], names=["sequence_id", "offset"])

    return F.arrow_udf(placed, "struct<sequence_id: bigint, offset: bigint>")(length, rank)


def packed(table: DataFrame, capacity: int, length: str = "length", order: list[str] | None = None) -> DataFrame:
    """table (one row per piece) with `sequence_id` and `offset`. order: columns that tell its rows apart."""
    table = staged(table, "pieces")
    counts = {int(n): int(c) for n, c in table.groupBy(length).count().collect()}  # at most `capacity` rows
    plan = supersteps(counts, capacity)
    at = looked_up(F.col(length), F.col("rank"), plan)
    return ranked(table, length, order or table.columns).withColumn("at", at).select(*table.columns, "at.sequence_id", "at.offset")


def cut_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every document; without ids, they stay in the workers and are null."""
    each = docs.select(F.col(id_column), F.explode(pieces(F.col(text), path, end, capacity, with_ids)).alias("x"))
    return each.select(id_column, "x.piece", "x.start", "x.length", "x.ids_crc32", "x.ids")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces with their ids; at most `capacity` ids meet in a row."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    small_batches(docs.sparkSession)
    table = cut_documents(docs, path, with_ids=False).drop("ids")
    return packed(table, CAPACITY, order=["doc_id", "piece"])


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"))
