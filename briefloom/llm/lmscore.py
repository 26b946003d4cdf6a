"""Stupid-backoff scores (Brants et al., EMNLP 2007) of order 2, from counts of the whole corpus.

    S(w | v) = c(v w) / c(v)          where c(v w) >= LEAST
             = 0.4 c(w) / N           otherwise

A document's score is the sum of the natural logarithms over its words; the first word follows a
start mark, whose count is the number of texts with words.  A pair that occurs once tells of nothing
but itself, hence LEAST = 2.

The n-grams of a document are exploded, partitioned by hash, and met there with the count table of the same
partition, which is made from them in place: one exchange serves both sides of the join.

* Frequent words (at least N / 2^20 occurrences, so at most 2^20 of them) are counted first, exactly.
  That bounded table goes to every task.  Pairs of the very frequent (the first TOP of them, at
  most TOP^2 pairs) are counted exactly as well and scored where they are read, so no hot pair crosses the network.
* A pair of frequent words is one 40-bit number, dealt by its hash.
* A pair with a rarer word is dealt by that word, so that its count and the pair's are both at hand
  there; where both are rare, it is dealt to both: the second word's place decides the
  backed-off term, the first word's the seen one.
* Tasks pack what they send to a partition into one row: numbers without their common
  bytes, and how many belong to each document, instead of a row for each n-gram.

Words are runs of bytes outside white space, as they are, told apart by 64-bit hashes (63 bits of the other word where both
words of a pair are rare).  A null id stays null.
Null and empty texts have no words and a score of 0.  Repeated rows count and are scored each on
its own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches, staged
from .textscan import blocks, mixed, words

ALPHA, LEAST, FREQUENT_BITS, TOP = 0.4, 2, 20, 1024
#: Bits of a frequent word's number.
WORD_BITS = 21
#: N-grams that a partition of the exchange is sized for, and a task holds before it sends.
PARTITION_NGRAMS, TASK_NGRAMS = 2_000_000, 2_000_000
#: Stands for a null id within.
_NO_ID = -(1 << 63)
_START = np.uint64(0x5354415254)
_RARE = np.uint64(1 << 63)
_PACKED = "bucket: int, kind: int, batch: bigint, docs: binary, runs: binary, low: binary, high: binary"


class Vocabulary(NamedTuple):
    """The frequent words: sorted hashes, their counts, their places by frequency; the corpus's words; how many
    places count as very frequent."""

    hashes: np.ndarray
    counts: np.ndarray
    place: np.ndarray
    total: int
    top: int

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is not frequent."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _pairs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each block: its first text's place, and of each word its text (from there), the word before and itself; texts."""
    for block in blocks(column, 1 << 20):
        text, own = words(block, lower=False)
        before = np.concatenate([[_START], own[:-1]]) if len(own) else own
        before[np.concatenate([[True], text[1:] != text[:-1]]) if len(own) else slice(0)] = _START
        yield block.first, text, before, own, len(block.offsets) - 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c) of all words and the start mark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_words = [np.concatenate([own, before[before == _START]]) for _, _, before, own, _ in _pairs(batch["text"])]
            h, c = np.unique(np.concatenate(all_words), return_counts=True) if all_words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return docs.select("text").mapInArrow(counted, "h: bigint, c: bigint").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(docs: DataFrame, frequent_bits: int, top: int) -> Vocabulary:
    counts = staged(word_counts(docs), "words")
    total = counts.where(F.col("h") != int(_START.view(np.int64))).agg(F.sum("c")).first()[0] or 0
    frequent = counts.where((F.col("c") * (1 << frequent_bits) >= total) | (F.col("h") == int(_START.view(np.int64))))
    rows = frequent.collect()  # at most 2^20 and the start mark
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    c = np.array([r.c for r in rows], np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    place = np.empty(len(h), np.int64)
    place[np.lexsort((h, -c))] = np.arange(len(h))
    return Vocabulary(h, c, place, total, top)


def top_pairs(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Counts of the pairs of very frequent words: [v * top + w] by their places."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        top = own.top
        sums = np.zeros(top * top, np.int64)
        for batch in batches:
            for _, _, before, after, _ in _pairs(batch["text"]):
                i, j = own.index(before), own.index(after)
                i, j = (np.where(x < 0, top, own.place[x]) for x in (i, j))
                both = (i < top) & (j < top)
                sums += np.bincount(i[both] * top + j[both], minlength=top * top)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["pair", "c"])

    found = docs.select("text").mapInArrow(counted, "pair: bigint, c: bigint").groupBy("pair").agg(F.sum("c").alias("c"))
    table = np.zeros(vocab.top**2, np.int64)
    for r in found.collect():  # at most the square of `top`
        table[r.pair] = r.c
    return table


def _dealt(kind: int, key: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, buckets: int, batch: int) -> Iterator[tuple]:
    """One row for each bucket: its entries in the order of documents."""
    to = (mixed(key) >> np.uint64(16)) % np.uint64(buckets)
    order = np.argsort(to.astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
    to, low, high, doc = to[order], low[order], high[order], doc[order]
    edges = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        part = slice(edges[b], edges[b + 1])
        d = doc[part]
        starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        runs = np.diff(np.concatenate([starts, [len(d)]])).astype(np.uint16 if len(d) < 65536 else np.uint32)
        yield b, kind, batch, d[starts].astype(np.uint32).tobytes(), runs.tobytes(), low[part].tobytes(), high[part].tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    names = ["bucket", "kind", "batch", "docs", "runs", "low", "high"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names) if rows else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, types))))


WHOLE, PAIR, AFTER, BEFORE = -1, 0, 1, 2  # of documents; two frequent words; a rare word and the one before it; a rare word and the one after it


def exploded(docs: DataFrame, vocab: Vocabulary, pairs: np.ndarray, buckets: int, task_ngrams: int) -> DataFrame:
    """Packed n-grams by bucket.  A row of kind WHOLE tells of a batch's documents: their ids, words and the score of
    their pairs of very frequent words; it goes to any bucket."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vocab, pairs))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        log_c, log_n = np.log(own.counts), np.log(max(1, own.total))
        part, number = TaskContext.get().partitionId(), 0
        held: list[list[np.ndarray]] = []
        ids: list[np.ndarray] = []
        n_words: list[np.ndarray] = []
        size = texts = 0

        def release() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, n_words, size, texts, number
            if not texts:
                return
            doc, before, after = (np.concatenate(x) for x in zip(*held))
            i, j = own.index(before), own.index(after)
            pi, pj = (np.where(x < 0, own.top, own.place[x]) for x in (i, j))
            batch = (part << 32) + number
            top = (pi < own.top) & (pj < own.top)
            c = known[pi[top] * own.top + pj[top]]
            term = np.where(c >= LEAST, np.log(np.maximum(c, 1)) - log_c[i[top]], np.log(ALPHA) + log_c[j[top]] - log_n)
            score = np.bincount(doc[top], term, minlength=texts)
            out = [((part * 31 + number) % buckets, WHOLE, batch, np.concatenate(ids).tobytes(), b"", np.concatenate(n_words).tobytes(), score.tobytes())]
            both = (i >= 0) & (j >= 0) & ~top
            pair = (i[both].astype(np.uint64) << np.uint64(WORD_BITS)) | j[both].astype(np.uint64)
            out += _dealt(PAIR, pair, (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32), (pair >> np.uint64(32)).astype(np.uint16), doc[both], buckets, batch)
            for kind, rare, other, at in ((AFTER, after, before, i), (BEFORE, before, after, j)):
                mine = (j if kind == AFTER else i) < 0
                name = np.where(at[mine] >= 0, at[mine].astype(np.uint64), other[mine] >> np.uint64(1) | _RARE)
                out += _dealt(kind, rare[mine], rare[mine], name, doc[mine], buckets, batch)
            held, ids, n_words, size, texts, number = [], [], [], 0, 0, number + 1
            for k in range(0, len(out), 512):
                yield _rows(out[k : k + 512])

        for batch in batches:
            doc_ids = batch["doc_id"].fill_null(_NO_ID).to_numpy()
            for first, text, before, after, n in _pairs(batch["text"]):
                held.append([text + texts, before, after])
                ids.append(doc_ids[first : first + n])
                n_words.append(np.bincount(text, minlength=n).astype(np.int64))
                size, texts = size + len(text), texts + n
                if size >= task_ngrams:
                    yield from release()
        yield from release()

    return docs.select("doc_id", "text").mapInArrow(sent, _PACKED)


def _scored_bucket(rows: list[dict], own: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of all rows that met in a partition: (batch, documents, sums of their terms)."""
    log_c, log_n, log_a = np.log(own.counts), np.log(max(1, own.total)), np.log(ALPHA)
    by_kind: dict[int, list[dict]] = {PAIR: [], AFTER: [], BEFORE: []}
    for r in rows:
        if r["kind"] != WHOLE:
            by_kind[r["kind"]].append(r)

    def arrays(kind: int, low: type, high: type) -> tuple[np.ndarray, np.ndarray]:
        mine = by_kind[kind]
        cat = lambda key, t: np.concatenate([np.frombuffer(r[key], t) for r in mine]) if mine else np.zeros(0, t)
        return cat("low", low).astype(np.uint64, copy=False), cat("high", high).astype(np.uint64, copy=False)

    def times(keys: np.ndarray) -> np.ndarray:
        _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return counts[where]

    terms = {}
    low, high = arrays(PAIR, np.uint32, np.uint16)
    pair = (high << np.uint64(32)) | low
    c = times(pair)
    i, j = (pair >> np.uint64(WORD_BITS)).astype(np.int64), (pair & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    terms[PAIR] = np.where(c >= LEAST, np.log(c) - log_c[i], log_a + log_c[j] - log_n)

    rare, name = arrays(AFTER, np.uint64, np.uint64)
    heads, c_word = np.unique(rare, return_counts=True)  # every occurrence of a rare word comes here once
    c = times(mixed(rare) + name * np.uint64(0x9E3779B97F4A7C15))
    frequent = name < _RARE
    seen = np.where(frequent, np.log(np.maximum(c, 1)) - log_c[np.where(frequent, name, 0).astype(np.int64)], 0.0)
    count = c_word[np.searchsorted(heads, rare)] if len(rare) else c
    terms[AFTER] = np.where(c >= LEAST, seen, log_a + np.log(np.maximum(count, 1)) - log_n)

    rare, name = arrays(BEFORE, np.uint64, np.uint64)
    c = times(mixed(rare) + name * np.uint64(0x9E3779B97F4A7C15))
    frequent = name < _RARE
    count = c_word[np.minimum(np.searchsorted(heads, rare), max(0, len(heads) - 1))] if len(rare) else c
    unseen = np.where(frequent, log_a + log_c[np.where(frequent, name, 0).astype(np.int64)] - log_n, 0.0)
    terms[BEFORE] = np.where(c >= LEAST, np.log(np.maximum(c, 1)) - np.log(np.maximum(count, 1)), unseen)

    for kind, mine in by_kind.items():
        at = 0
        for r in mine:
            docs = np.frombuffer(r["docs"], np.uint32)
            runs = np.frombuffer(r["runs"], np.uint16 if len(r["runs"]) == 2 * len(docs) else np.uint32).astype(np.int64)
            size = int(runs.sum())
            yield r["batch"], docs, np.add.reduceat(terms[kind][at : at + size], np.concatenate([[0], np.cumsum(runs)[:-1]]))
            at += size


def _part(batch: int, whole: bool, docs: bytes, n_words: bytes, sums: bytes) -> pa.RecordBatch:
    columns = [pa.array([batch], pa.int64()), pa.array([whole]), *(pa.array([x], pa.binary()) for x in (docs, n_words, sums))]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "whole", "docs", "n_words", "sums"])


def backoff_scores(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    frequent_bits: int = FREQUENT_BITS,
    top: int = TOP,
    partition_ngrams: int = PARTITION_NGRAMS,
    task_ngrams: int = TASK_NGRAMS,
) -> DataFrame:
    """id, n_words and score of every document.  The numbers set where n-grams are met, never what is returned."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    vocab = vocabulary(docs, frequent_bits, top)
    if not len(vocab.hashes):
        return docs.select(F.col("doc_id").alias(id_column), F.lit(0).cast("bigint").alias("n_words"), F.lit(0.0).alias("score"))
    pairs = top_pairs(docs, vocab)
    buckets = max(8, -(-vocab.total // partition_ngrams))
    dealt = exploded(docs, vocab, pairs, buckets, task_ngrams).repartitionById(buckets, F.col("bucket"))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        for r in rows:
            if r["kind"] == WHOLE:
                yield _part(r["batch"], True, r["docs"], r["low"], r["high"])
        out: dict[int, list] = {}
        for batch, at, sums in _scored_bucket(rows, shared.value):
            out.setdefault(batch, []).append((at, sums))
        for batch, parts in out.items():
            at, sums = (np.concatenate(x) for x in zip(*parts))
            full, where = np.unique(at, return_inverse=True)
            yield _part(batch, False, full.tobytes(), b"", np.bincount(where, sums).tobytes())

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        whole = next(r for r in rows if r["whole"])
        total = np.frombuffer(whole["sums"], np.float64).copy()
        for r in rows:
            if not r["whole"]:
                total[np.frombuffer(r["docs"], np.uint32)] += np.frombuffer(r["sums"], np.float64)
        ids = np.frombuffer(whole["docs"], np.int64)
        columns = [pa.array(ids, mask=ids == _NO_ID), pa.array(np.frombuffer(whole["n_words"], np.int64)), pa.array(total)]
        return pa.table(columns, names=[id_column, "n_words", "score"])

    parts = dealt.mapInArrow(scored, "batch bigint, whole boolean, docs binary, n_words binary, sums binary")
    # a batch is a bounded number of documents' words
    return parts.groupBy("batch").applyInArrow(summed, f"{id_column}: bigint, n_words: bigint, score: double")


def op3_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = backoff_scores(docs)
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).otherwise(0.0)
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round(mean, 6).alias("mean_log_score"))
