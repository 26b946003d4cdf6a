"""Hard negatives of anchors by inner products, with coordinate pruning in length buckets (after LEMP).

1. Rows are range-sorted by length and packed into buckets of up to BUCKET rows.  A bucket holds, besides its rows,
   for every coordinate the list of its rows sorted by that coordinate of the unit vector.
2. Anchors are packed into blocks; each block meets the buckets, a stated query set against all rows.  A bucket
   whose longest row can't reach the least score that any anchor of the block still looks for is left out by the join.
3. Within a bucket, a score in [low, high] is an angle between the anchor and the row of at most t_low and at least t_high
   (from the bucket's lengths).  With the anchor at angle a from the axis of a coordinate, the row's angle b has
   |a - b| <= t_low and t_high <= min(a + b, 2 pi - a - b), which is a range of that coordinate: a run of its sorted list.  The runs
   of the FOCUS coordinates that are largest in the anchor are intersected; what is in all of them is scored exactly, in integers.
4. Each anchor first looks at the bucket of the longest rows; its fifth best score there is a floor for the rest, and
   floors rise from bucket to bucket.  Only what can't be among the first is pruned, so results are exact.

Step 4 is run twice: for the positives (rows of the anchor's label), then for the negatives (other labels), where each
positive asks for scores in [percent/100 of its own, its own].

Rows with a null label, a null vector, or a null or non-finite entry take no part.  Entries are held within ±2^26 after
scaling; shorter vectors count as filled up with zeros, and a vector of zeros has the score 0 with all.  A row is itself and not its id:
rows of one id are different rows, and ties of score and id are told apart within.  A null id is no anchor and
comes after all others in ties.  An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import small_batches, staged
from .textscan import release
from .vectors import integers, is_whole, matrix, padded

LIMIT = 1 << 26
BUCKET, BLOCK, FOCUS = 2048, 256, 3
#: Buckets of a group that meets blocks in one task.
GROUP = 64
#: Bounds of scores that stand for none, and a null id within.
NO_LOW, NO_HIGH, NO_ID = -(1 << 62), 1 << 62, (1 << 63) - 1
_SLACK = 1e-9
_BUCKET = "bucket bigint, shortest double, longest double, key binary, id binary, label binary, x binary, lists binary"
_BLOCK = "block bigint, reach double, key binary, label binary, x binary, low binary, high binary"
_FOUND = "key bigint, ask int, other bigint, id bigint, score bigint"


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of `size`, the last of fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held = table.slice(size).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.sqrt((x * x).sum(axis=1))


def _units(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return x / np.where(lengths > 0, lengths, 1.0)[:, None]


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _small(x: np.ndarray) -> bytes:
    """A matrix in the least integers that hold it, with their width in the first byte."""
    most = int(np.abs(x).max()) if x.size else 0
    kind = np.int16 if most < 1 << 15 else np.int32
    return bytes([np.dtype(kind).itemsize]) + _bytes(x.astype(kind))


def _large(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if data[0] == 2 else np.int32, offset=1).reshape(rows, -1).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for table in _packed(batches, BUCKET):
        key, ids, label, x = *(table[c].to_numpy() for c in ("key", "id", "label")), matrix(table["x"])
        lengths = _lengths(x)
        lists = np.argsort(_units(x, lengths), axis=0, kind="stable").T.astype(np.uint16)
        row = {"bucket": int(key[0]), "shortest": lengths.min(), "longest": lengths.max(), "key": _bytes(key), "id": _bytes(ids), "label": _bytes(label), "x": _small(x), "lists": _bytes(lists)}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.int64() if k == "bucket" else pa.float64() if k in ("shortest", "longest") else pa.binary()) for k in row]))


class Bucket:
    """Rows of about one length, with a sorted list for each coordinate."""

    def __init__(self, row: dict):
        self.key, self.id, self.label = (np.frombuffer(row[c], np.int64) for c in ("key", "id", "label"))
        self.shortest, self.longest, n = row["shortest"], row["longest"], len(self.key)
        self.x = _large(row["x"], n)
        self.units = _units(self.x, _lengths(self.x))
        self.lists = np.frombuffer(row["lists"], np.uint16).reshape(-1, n)
        self.sorted: dict[int, np.ndarray] = {}
        self.most = int(np.abs(self.x).max()) if self.x.size else 0

    def run(self, coordinate: int, low: float, high: float) -> np.ndarray:
        """Rows whose unit vector has the coordinate in [low, high]: a run of its sorted list."""
        if coordinate not in self.sorted:
            self.sorted[coordinate] = self.units[self.lists[coordinate], coordinate]
        values = self.sorted[coordinate]
        return self.lists[coordinate][np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]

    def scores(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where these hold every sum, else in 64-bit integers."""
        if self.most * int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 53:
            return (self.x[rows].astype(float) @ x.astype(float)).astype(np.int64)
        return (self.x[rows] * x).sum(axis=1)


def feasible(coordinate: float, t_low: float, t_high: float) -> tuple[float, float]:
    """The range of a coordinate of unit vectors at angles of t_high to t_low from one that has it at `coordinate`."""
    a = math.acos(max(-1.0, min(1.0, coordinate)))
    least, most = max(0.0, a - t_low, t_high - a), min(math.pi, a + t_low, 2 * math.pi - a - t_high)
    return math.cos(most) - _SLACK, math.cos(least) + _SLACK


def _angles(low: int, high: int, length: float, bucket: Bucket) -> tuple[float, float] | None:
    """The largest and the least angle at which a row of the bucket has a score in [low, high] with a vector of a length; None: no row has."""
    long, short = length * bucket.longest, length * bucket.shortest
    if low > long * (1 + _SLACK):
        return None
    c_low = -1.0 if low <= 0 and -low >= short else low / long if low > 0 else low / short
    c_high = 1.0 if high >= 0 and high >= short else high / short if high >= 0 else high / long if long else -1.0
    if c_high < -1 - _SLACK:
        return None
    return math.acos(max(-1.0, min(1.0, c_low - _SLACK))), math.acos(max(-1.0, min(1.0, c_high + _SLACK)))


class Search:
    """What the anchors of one block have found so far: for each anchor and each of its asks, [low, high], the first `take`."""

    def __init__(self, row: dict, same: bool, take: int):
        self.key, self.label = (np.frombuffer(row[c], np.int64) for c in ("key", "label"))
        n = len(self.key)
        self.x, self.same, self.take = _large(row["x"], n), same, take
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(n, -1).copy() for c in ("low", "high"))
        self.lengths = _lengths(self.x)
        self.units = _units(self.x, self.lengths)
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, :FOCUS]
        self.found: dict[tuple[int, int], np.ndarray] = {}

    def candidates(self, i: int, low: int, high: int, bucket: Bucket) -> np.ndarray:
        angles = _angles(low, high, self.lengths[i], bucket)
        if angles is None:
            return np.zeros(0, np.int64)
        counts = np.zeros(len(bucket.key), np.uint8)
        for f in self.focus[i].tolist():
            counts[bucket.run(f, *feasible(self.units[i, f], *angles))] += 1
        return np.flatnonzero(counts == len(self.focus[i]))

    def meet(self, bucket: Bucket) -> None:
        for i in range(len(self.key)):
            asks = np.flatnonzero(self.low[i] <= self.high[i])
            if not len(asks):
                continue
            rows = self.candidates(i, int(self.low[i, asks].min()), int(self.high[i, asks].max()), bucket)
            rows = rows[(bucket.label[rows] == self.label[i]) == self.same]
            rows = rows[bucket.key[rows] != self.key[i]]
            if not len(rows):
                continue
            scores = bucket.scores(rows, self.x[i])
            for ask in asks.tolist():
                fit = np.flatnonzero((scores >= self.low[i, ask]) & (scores <= self.high[i, ask]))
                if len(fit):
                    self.add(i, ask, np.column_stack([scores[fit], bucket.id[rows[fit]], bucket.key[rows[fit]]]))

    def add(self, i: int, ask: int, new: np.ndarray) -> None:
        had = self.found.get((i, ask))
        both = new if had is None else np.concatenate([had, new])
        both = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.take]]
        self.found[i, ask] = both
        if len(both) == self.take:
            self.low[i, ask] = max(self.low[i, ask], both[-1, 0])

    def batch(self) -> pa.RecordBatch:
        rows = [(int(self.key[i]), ask, *map(int, (k, d, s))) for (i, ask), found in self.found.items() for s, d, k in found]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "ask", "other", "id", "score"])


def _blocks(first: dict, same: bool, take: int):
    """Packs anchors (key, label, x, low, high: one of each for an ask) into blocks, with floors from the first bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bucket = Bucket(first)
        for table in _packed(batches, BLOCK):
            key, label, x = table["key"].to_numpy(), table["label"].to_numpy(), matrix(table["x"])
            low, high = table["low"].to_pylist(), table["high"].to_pylist()
            width = max(map(len, low))
            low, high = (np.array([r + [fill] * (width - len(r)) for r in side], np.int64) for side, fill in ((low, 1), (high, 0)))
            row = {"block": int(key[0]), "key": _bytes(key), "label": _bytes(label), "x": _small(x), "low": _bytes(low), "high": _bytes(high)}
            search = Search(row, same, take)
            search.meet(bucket)
            least = np.where(search.low <= search.high, search.low, NO_HIGH).min(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(least <= 0, 0.0, least / search.lengths)
            row |= {"low": _bytes(search.low), "reach": float(np.nan_to_num(reach, nan=0.0, posinf=np.finfo(float).max).min()) * (1 - _SLACK)}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.int64() if k == "block" else pa.float64() if k == "reach" else pa.binary()) for k in ("block", "reach", "key", "label", "x", "low", "high")]))

    return run


def _searched(same: bool, take: int):
    """Of rows that each hold a block (a_...) and a bucket, those of a block together: what the block's anchors find in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        search, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if search is None or (row["a_block"], row["part"]) != block:
                    if search is not None and search.found:
                        yield search.batch()
                    block = row["a_block"], row["part"]
                    search = Search({c: row[f"a_{c}"] for c in ("key", "label", "x", "low", "high")}, same, take)
                search.meet(Bucket(row))
        if search is not None and search.found:
            yield search.batch()

    return run


def _first(anchors: DataFrame, n: int, buckets: DataFrame, parts: int, first: dict, same: bool, take: int) -> DataFrame:
    """(key, ask, other, id, score, rank): for each of n anchors and each of its asks the first `take` rows with scores in [low, high]."""
    blocks = staged(anchors.repartition(-(-n // BLOCK), "key").select("key", "label", "x", "low", "high").mapInArrow(_blocks(first, same, take), _BLOCK), "blocks")
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = left.join(buckets.hint("merge"), "part").where(F.col("longest") >= F.col("a_reach"))
    found = met.mapInArrow(_searched(same, take), _FOUND)
    rank = F.row_number().over(Window.partitionBy("key", "ask").orderBy(F.desc("score"), "id", "other"))  # `take` rows of each group of buckets
    return staged(found.withColumn("rank", rank).where(F.col("rank") <= take), "found")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of other labels whose score
    is from percent/100 of the positive's to the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    is_anchor: a condition on rows; label: integers."""
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.where(F.col(label).isNotNull() & is_whole(F.col(vector)))
    own = own.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(label).cast("bigint").alias("label"), (is_anchor & F.col(id_column).isNotNull()).alias("anchor"), integers(F.col(vector), LIMIT).alias("x"))
    own, _ = padded(own, "x")
    own = staged(own.withColumn("key", F.monotonically_increasing_id()), "vectors")  # written, so that a row keeps its key
    length = F.aggregate("x", F.lit(0).cast("bigint"), lambda s, v: s + v * v)
    n, n_anchors = own.agg(F.count("*"), F.count_if("anchor")).first()
    kept = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return spark.createDataFrame([], kept)
    ranged = own.withColumn("length", length).repartitionByRange(max(1, n // (4 * BUCKET)), "length", "key").sortWithinPartitions("length", "key")
    buckets = staged(ranged.select("key", "id", "label", "x").mapInArrow(_buckets, _BUCKET), "buckets")
    parts = max(spark.sparkContext.defaultParallelism, buckets.count() // GROUP)
    first = buckets.orderBy(F.desc("longest"), "bucket").first().asDict()  # one bucket, BUCKET rows at most
    buckets = buckets.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int"))
    anchors = own.where("anchor").select("key", "id", "label", "x")
    longs = lambda c: F.array(c.cast("bigint"))
    same = anchors.withColumn("low", longs(F.lit(NO_LOW))).withColumn("high", longs(F.lit(NO_HIGH)))
    best = _first(same, n_anchors, buckets, parts, first, True, positives).select("key", F.col("rank").alias("ask"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The least score allowed, rounded up; a negative positive score allows none.
    exact = F.expr(f"CAST(CEIL(CAST(positive_score AS decimal(20,0)) * {percent} / 100) AS bigint)")
    asked = best.withColumn("low", exact).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ask", "low", "positive_score"))).alias("asks"))  # `positives` at most
    asked = asked.select("key", F.col("asks.low").alias("low"), F.col("asks.positive_score").alias("high"))
    other = anchors.join(asked.hint("merge"), "key")
    found = _first(other, n_anchors, buckets, parts, first, False, negatives).select("key", (F.col("ask") + 1).alias("ask"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    told = found.join(best.hint("merge"), ["key", "ask"]).join(anchors.select("key", F.col("id").alias("anchor_id")).hint("merge"), "key")
    return told.select("anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
),
ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 5
"""
