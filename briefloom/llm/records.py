"""Token files of length-delimited records, with an offset index.

A file is a header of 16 bytes (a magic word of 8, the bytes of one id as an unsigned 32-bit integer,
4 zero bytes), then records.  A record is

    length of the payload      unsigned 64-bit
    masked checksum of those 8 bytes   unsigned 32-bit
    payload: 1 if the document has an id, else 0   8-bit
             document id, or 0 signed 64-bit
             ids               unsigned, 2 or 4 bytes each
    masked checksum of the payload     unsigned 32-bit

all little-endian.  The checksum is CRC-32, masked by rotation and addition as in TFRecord files, so
that a checksum of data that holds checksums stays sound.  The index is a table with a row for each
record: file, offset, length; any record can be read by itself, so a shuffled order of
the index is a shuffled read.

Documents are range-partitioned by id, so files ascend by id in their numbers, and records within
files.  A task writes files of its own name; only files of tasks that ended well come into the
index, so a task that is lost or runs twice leaves at most a file that nobody reads.
The index is the list of what holds.  Null texts count as empty: only the end id.
Documents with one id follow each other, ordered by a hash of their text; those with a null id come first and keep it.
An empty table gives an empty index.  Ids take 2 bytes where the vocabulary's largest id allows, else 4; 2 for a larger one is refused.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import new_folder, small_batches, staged
from .tokens import encoded, encoder

MAGIC = b"BLTOKEN2"
HEADER = 16
FILE_BYTES, READ_BYTES, BATCH_ROWS = 256 << 20, 16 << 20, 5_000
INDEX = "file: string, part: int, roll: int, doc_id: bigint, offset: bigint, length: bigint, n_tokens: bigint"


_OWNER = "<?q"


def _unpacked(payload: bytes, id_bytes: int) -> tuple[int | None, bytes]:
    """The document's id and its token ids as unsigned 32-bit integers."""
    known, doc_id = struct.unpack_from(_OWNER, payload)
    return doc_id if known else None, np.frombuffer(payload[struct.calcsize(_OWNER) :], f"<u{id_bytes}").astype("<u4").tobytes()


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframed(stream) -> bytes | None:
    """The next record's payload; None at the end. A record that is cut off or damaged raises ValueError."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return body[:size]


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, vocabulary: str, end: int = 0, id_bytes: int | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of every text into files of the folder; returns the index, as a table of the shared folder."""
    small_batches(docs.sparkSession)
    whole = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = whole.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        part, run, roll, out, at, name = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None, 0, ""
        rows: list[tuple] = []
        largest = max(end, encoder(vocabulary).largest)
        width = id_bytes or (2 if largest < 1 << 16 else 4)
        if largest >= 1 << 8 * width:
            raise ValueError(f"ids up to {largest} do not fit into {width} bytes")
        try:
            for batch in batches:
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded(batch["text"], vocabulary, end)):
                    if out is None:
                        name, at = f"tokens-{part:06d}-{roll:04d}-{run}.bin", HEADER
                        out = files.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC + struct.pack("<II", width, 0))
                    if width == 2:
                        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                    record = frame(struct.pack(_OWNER, doc_id is not None, doc_id or 0) + ids)
                    out.write(record)
                    rows.append((name, part, roll, doc_id, at, len(record), len(ids) // width))
                    at += len(record)
                    if at >= FILE_BYTES:
                        out.close()
                        out, roll = None, roll + 1
                    if len(rows) >= BATCH_ROWS:
                        yield _index_batch(rows)
                        rows = []
        finally:
            if out is not None:
                out.close()
        yield _index_batch(rows)

    return staged(ordered.mapInArrow(written, INDEX), "index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["file", "part", "roll", "doc_id", "offset", "length", "n_tokens"]
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(part, roll, segment, place, doc_id, ids) of all records: files are read in segments of about READ_BYTES,
    each in order, so a large file is the work of several tasks. ids are little-endian unsigned 32-bit integers."""
    total = index.agg(F.sum("length")).first()[0] or 0
    segments = (
        index.withColumn("segment", F.floor(F.col("offset") / READ_BYTES))
        .groupBy("file", "part", "roll", "segment")
        .agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"))
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_input_file(f"{root}/{r['file']}") as source:
                    magic, id_bytes, _ = struct.unpack("<8sII", source.read(HEADER))
                    if magic != MAGIC:
                        raise ValueError(f"{r['file']} is no token file")
                    source.seek(r["first"])
                    place, ids, docs, size = 0, [], [], 0
                    while source.tell() < r["last"]:
                        doc_id, own = _unpacked(unframed(source), id_bytes)
                        docs.append(doc_id)
                        ids.append(own)
                        size += len(ids[-1])
                        if size >= READ_BYTES // 4 or source.tell() >= r["last"]:
                            n = len(docs)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([r[k]] * n, t) for k, t in (("part", pa.int32()), ("roll", pa.int32()), ("segment", pa.int64()))]
                                + [pa.array(range(place, place + n), pa.int64()), pa.array(docs, pa.int64()), pa.array(ids, pa.binary())],
                                names=["part", "roll", "segment", "place", "doc_id", "ids"],
                            )
                            place, ids, docs, size = place + n, [], [], 0

    return segments.repartition(max(1, -(-total // READ_BYTES)), "file", "segment").mapInArrow(parsed, "part int, roll int, segment bigint, place bigint, doc_id bigint, ids binary")


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the records that rows of the index point to, in any order."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        for batch in batches:
            docs, ids = [], []
            for r in batch.to_pylist():
                with files.open_input_file(f"{root}/{r['file']}") as source:
                    id_bytes = struct.unpack("<8sII", source.read(HEADER))[1]
                    source.seek(r["offset"])
                    doc_id, own = _unpacked(unframed(source), id_bytes)
                    docs.append(doc_id)
                    ids.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return index.select("file", "offset").mapInArrow(fetched, "doc_id bigint, ids binary")


def positions(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of read_records(): where each document's ids begin among all ids in file order."""
    each = staged(read.select("part", "roll", "segment", "place", "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "read")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    segments = each.groupBy("part", "roll", "segment").agg(F.sum("n_tokens").alias("n"))
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task that wrote
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("of_part"))
    own = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("part").orderBy("roll", "segment"))), F.lit(0))
    base = segments.withColumn("own", own).join(parts.hint("merge"), "part").select("part", "roll", "segment", (F.col("own") + F.col("of_part")).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("part", "roll", "segment").orderBy("place"))), F.lit(0))
    found = each.withColumn("within", within).join(base.hint("merge"), ["part", "roll", "segment"])
    return found.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_records(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_folder(spark, "tokens")
    index = write_records(docs, folder, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return positions(read_records(index, folder))
