"""SentencePiece encoding and decoding as a max-plus scan.

A text is segmented into vocabulary pieces with the largest sum of their scores (the unigram search of
SentencePiece; the scores are those of the model file, also where it was made by merges).
Characters without a piece cost the least score minus 10 and become byte pieces.

A text of up to GIANT characters is the work of one row.  A longer one is split at every CHUNK
characters, in the middle of words or not, and the chunks are spread over tasks:

1. Each chunk yields a transfer matrix over boundary states.  State s at a boundary says that the
   first piece that begins at or after it begins s characters after it; entry (s, e) is the best score of a way
   through the chunk from s at its start to e at its end, in max-plus arithmetic.  Where a word
   begins inside, no piece crosses that place (in no vocabulary piece a word start follows another
   character), so only the ends of the chunk need a search; the middle adds one number to all
   entries, which changes no choice and is left out.
2. The matrices are combined by the associative max-plus product into the best prefix scores,
   which fix the state at each boundary.
3. Each chunk is then segmented between its two states, independently of the others.

Within a row, words (with the spaces before them) are independent for the same reason, so each distinct one is
searched once: plain short ones by the sentencepiece library, others here, in double precision.

Null and empty texts have no ids.  Repeated rows are encoded each on its own.  Decoding gives
the text back, but for U+2581, which the format itself reads as a space.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches, staged
from .textscan import Block, hold
from .tokens import Encoder, _Half

GIANT, CHUNK, LONG_WORD = 32_768, 8_192, 200
MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_NEVER = float("-inf")


def piece_words(block: Block, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts before each space that follows neither a space nor U+2581, around bytes that no piece holds, and at the texts' starts."""
    data = block.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    space = data == 0x20
    cut[1:-1] = space[1:] & ~space[:-1]
    if len(data) > 3:
        cut[3:-1] &= ~((data[2:-1] == 0x81) & (data[1:-2] == 0x96) & (data[:-3] == 0xE2))
    own = alone[data]
    cut[:-1] |= own
    cut[1:] |= own
    cut[block.offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


class PieceEncoder(Encoder):
    """Texts come with a space in front where they begin a document."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as messages

        model = messages.ModelProto.FromString(open(path, "rb").read())
        model.trainer_spec.model_type = messages.TrainerSpec.UNIGRAM
        model.normalizer_spec.add_dummy_prefix = False  # texts bring their own
        self.library = SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = messages.ModelProto.SentencePiece
        self.pieces: dict[str, tuple[float, int]] = {}
        self.scores, self.bytes = np.zeros(len(model.pieces)), [b""] * len(model.pieces)
        self.byte_ids = [0] * 256
        self.lead = np.zeros(len(model.pieces), bool)
        for i, p in enumerate(model.pieces):
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.pieces[p.piece] = (p.score, i)
                self.scores[i], self.bytes[i] = p.score, p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.BYTE:
                value = int(_BYTE.fullmatch(p.piece)[1], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
                self.lead[i] = value & 0xC0 != 0x80
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        self.scores[self.lead] = self.unknown
        self.longest = max(map(len, self.pieces))
        self.new, self.old, self.added, self.fold = _Half(), None, [], False
        self.single = {" ", *(p for p in self.pieces if len(p) == 1)}
        held = "".join(self.pieces)
        self.alone = np.array([i < 128 and i != 0x20 and chr(i) not in held for i in range(256)])

    def cut(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        return piece_words(block, self.alone)

    def _each(self, texts: list[str]) -> list[list[int]]:
        # the library adds scores in single precision, which is exact only without those of unknown characters and runs of spaces
        plain = [len(x) <= LONG_WORD and self.single.issuperset(x) and " " not in x[1:] and MARK not in x for x in texts]
        # its lattice search is exact; its default one misses the best segmentation of some words
        return [self.library.nbest_encode(x, nbest_size=2)[0] if s else self.searched(x) for x, s in zip(texts, plain)]

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = data.tobytes()
        each = self._each([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        size = np.array([len(x) for x in each], np.int64)
        return np.array([i for x in each for i in x], np.uint32), np.cumsum(size) - size, size

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def steps(self, text: str, at: int):
        """(length, score, id) of the pieces that begin at a place of marked text; id -1: no piece has the character."""
        single = False
        for n in range(1, min(self.longest, len(text) - at) + 1):
            found = self.pieces.get(text[at : at + n])
            if found:
                single |= n == 1
                yield n, *found
        if not single:
            yield 1, self.unknown, -1

    def searched(self, text: str) -> list[int]:
        """The ids of the best segmentation; of equal ones, that with the longest last piece, and so on before it."""
        text = text.replace(" ", MARK)
        best, back = [0.0] + [_NEVER] * len(text), [(0, 0)] * (len(text) + 1)
        for at in range(len(text)):
            for n, score, piece in self.steps(text, at):
                if best[at] + score > best[at + n]:
                    best[at + n], back[at + n] = best[at] + score, (n, piece)
        at, out = len(text), []
        while at:
            n, piece = back[at]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[at - n : at].encode())]
            at -= n
        return out[::-1]

    def through(self, text: str, starts: np.ndarray, end: int) -> np.ndarray:
        """For each start state (row) the best score to leave at end + e (column), never beginning a piece at or after end.
        starts: a row for each state, with its score at each of the first places of the text."""
        reach = np.full((len(text) + self.longest + 1, len(starts)), _NEVER)
        reach[: starts.shape[1]] = starts.T
        for at in range(min(end, len(text))):
            if (reach[at] > _NEVER).any():
                for n, score, _ in self.steps(text, at):
                    np.maximum(reach[at + n], reach[at] + score, out=reach[at + n])
        return reach[end : end + self.longest].T

    def matrix(self, chunk: str, last: bool) -> np.ndarray:
        """The transfer matrix of a chunk with its overlap (longest - 1 characters of the next; the last has none)."""
        text, k = chunk.replace(" ", MARK), self.longest
        size = len(text) if last else CHUNK
        cuts = [i for i in range(k, size) if text[i] == MARK and text[i - 1] != MARK]
        states = np.where(np.eye(k, dtype=bool), 0.0, _NEVER)
        if not cuts:
            return self.through(text, states, size)
        head = self.through(text[: cuts[0]], states, cuts[0])[:, 0]
        tail = self.through(text[cuts[-1] :], states[:1], size - cuts[-1])[0]
        return head[:, None] + tail[None, :]


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: the transfer matrix of two neighbours."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halving: pairs are combined first, so the depth is logarithmic."""
    if len(matrices) == 1:
        return matrices
    pairs = prefixes([combined(*matrices[i : i + 2]) for i in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else combined(pairs[i // 2 - 1], matrices[i]))
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at the start of each chunk and at the end of the last (0)."""
    before = prefixes(matrices)
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(before[k - 1][0] + matrices[k][:, states[-1]])))
    return [0, *states[::-1]]


def model(path: str) -> PieceEncoder:
    return hold(f"pieces {path}", lambda: PieceEncoder(path))


_RESULT = "struct<ids: binary, score: double, same: boolean>"


def _result(texts: list[str], own: PieceEncoder) -> pa.Array:
    """ids, score and whether the ids give each text back.  All in one pass, so a task needs one Python worker."""
    ids, score, same = [], [], []
    for text, x in zip(texts, own.encode(pa.array(texts, pa.large_string()))):
        ids.append(x.astype("<u4").tobytes())
        score.append(float(own.scores[x].sum()))
        same.append(own.text(x) == text.replace(MARK, " "))
    return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())], names=["ids", "score", "same"])


def encoded_whole(text: Column, path: str) -> Column:
    """ids (little-endian unsigned 32-bit integers) and score of each text."""

    def run(column: pa.Array) -> pa.Array:
        return _result([" " + x if x else "" for x in column.to_pylist()], model(path))

    return F.arrow_udf(run, _RESULT)(text)


def decoded(ids: Column, path: str, first: Column) -> Column:
    """The text of ids; where `first` holds, they begin a document, whose leading space is the format's."""

    def run(column: pa.Array, begins: pa.Array) -> pa.Array:
        own, out = model(path), []
        for x, b in zip(column.to_pylist(), begins.to_pylist()):
            text = own.text(np.frombuffer(x, "<u4"))
            out.append(text[1:] if b and text[:1] == " " else text)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(ids, first)


def _chunks(text: Column, path: str) -> Column:
    def run(column: pa.Array) -> pa.Array:
        over, out = model(path).longest - 1, []
        for x in column.to_pylist():
            x = " " + x
            out.append([{"chunk": k // CHUNK, "last": k + CHUNK >= len(x), "body": x[k : k + CHUNK + over]} for k in range(0, len(x), CHUNK)])
        return pa.array(out, pa.list_(pa.struct([("chunk", pa.int32()), ("last", pa.bool_()), ("body", pa.string())])))

    return F.arrow_udf(run, "array<struct<chunk: int, last: boolean, body: string>>")(text)


def _matrices(body: Column, last: Column, path: str) -> Column:
    def run(bodies: pa.Array, lasts: pa.Array) -> pa.Array:
        own = model(path)
        return pa.array([own.matrix(b, e).ravel() for b, e in zip(bodies.to_pylist(), lasts.to_pylist())], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(body, last)


def _states(matrices: Column) -> Column:
    """From the sorted (chunk, matrix) of a document: (chunk, enter, leave)."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            flat = [np.array(x["m"].values) for x in row]
            k = int(len(flat[0]) ** 0.5)
            at = boundary_states([x.reshape(k, k) for x in flat])
            out.append([{"chunk": i, "enter": at[i], "leave": at[i + 1]} for i in range(len(flat))])
        return pa.array(out, pa.list_(pa.struct([("chunk", pa.int32()), ("enter", pa.int32()), ("leave", pa.int32())])))

    return F.arrow_udf(run, "array<struct<chunk: int, enter: int, leave: int>>")(matrices)


def _encoded_between(body: Column, last: Column, enter: Column, leave: Column, path: str) -> Column:
    def run(*columns: pa.Array) -> pa.Array:
        return _result([b[s : None if e else CHUNK + x] for b, e, s, x in zip(*[c.to_pylist() for c in columns])], model(path))

    return F.arrow_udf(run, _RESULT)(body, last, enter, leave)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", giant: int = GIANT) -> DataFrame:
    """id, n_chunks, ids, score and same (whether decoding gives the text) of every document."""
    small_batches(docs.sparkSession)
    whole = docs.select(F.col(id_column), F.coalesce(text, F.lit("")).alias("text"))
    small = whole.where(F.char_length("text") <= giant).withColumn("x", encoded_whole(F.col("text"), path))
    small = small.select(id_column, F.lit(1).alias("n_chunks"), "x.ids", "x.score", "x.same")
    giants = staged(whole.where(F.char_length("text") > giant).withColumn("row", F.monotonically_increasing_id()), "giants")
    chunks = giants.select("row", F.explode(_chunks(F.col("text"), path)).alias("c")).select("row", "c.*")
    chunks = staged(chunks.repartition("row", "chunk"), "chunks")
    listed = chunks.withColumn("m", _matrices(F.col("body"), F.col("last"), path)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "m"))).alias("ms"))
    states = listed.select("row", F.explode(_states(F.col("ms"))).alias("s")).select("row", "s.*")
    each = chunks.join(states.hint("merge"), ["row", "chunk"]).withColumn("x", _encoded_between(F.col("body"), F.col("last"), F.col("enter"), F.col("leave"), path))
    parts = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "x.ids"))).alias("parts"), F.sum("x.score").alias("score"), F.bool_and("x.same").alias("same"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))  # in one pass, whatever the number of chunks
    large = giants.select(id_column, "row").join(parts.hint("merge"), "row").select(id_column, F.size("parts").alias("n_chunks"), joined.alias("ids"), "score", "same")
    return small.unionByName(large)


def op4_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    n_ids = (F.length("ids") / 4).cast("bigint")
    return out.select("doc_id", n_ids.alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "score", "n_chunks", F.col("same").alias("round_trip"))
