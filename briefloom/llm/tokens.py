"""Token ids of whole texts by the public tokenizers library.

A text is cut into segments at places where the tokenizer surely cuts as well: around words, and within a
word between ASCII letters, digits and other marks.  Each segment that is not remembered is encoded by the library,
and the ids of a text are gathered from those of its segments by numpy.  The memory of segments is bounded and keeps
what is in use; which segments it holds never changes a result.  Which cuts suit a vocabulary is asked of
the tokenizer when it is loaded; where none does, whole texts go to the library.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .textscan import LOWER, SPACE, Block, blocks, hold, span_hashes, trim

_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
#: 1: ASCII letters, 2: digits, 3: other visible ASCII. The apostrophe, which may begin a contraction, is in none.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[0x27] = 0
_SAMPLE = "Ab1's  a\n\n b. éà !? x\n y. a.b(c)d 12ab-34,5 $x 'q' x.'s don't. it.'t(é)ö?\tz1.5%"
_LETTERS = "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z It'S AB"

#: Bytes of a block of texts; slots of each of the memory's two halves, how many of them fill up, tries for a free one;
#: ids up to which a segment is remembered, bytes up to which its hash tells it apart, ids that a half holds; bytes that the library
#: gets in a call (it needs a hundred times as many).
BLOCK_BYTES, SLOTS, FULL, TRIES, KNOWN_IDS, KNOWN_BYTES, HELD_IDS, CALL_BYTES = 1 << 19, 1 << 19, 1 << 18, 8, 30, 256, 1 << 21, 1 << 16


def _spans(solid: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of solid bytes that no edge (before a byte) divides."""
    starts = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | edge[1:])) + 1
    return starts, ends


def _inner(data: np.ndarray) -> np.ndarray:
    """Where visible ASCII characters of different classes meet (before each byte, and one more)."""
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return cut


def bare_words(block: Block, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between ASCII white space; for vocabularies that drop spaces."""
    edge = _inner(block.data) if inner else np.zeros(len(block.data) + 1, bool)
    edge[block.offsets] = True
    return _spans(~SPACE[block.data], edge)


def spaced_words(block: Block, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words with the space before them; for byte-level vocabularies.
    A cut is made before white space that follows a visible ASCII character, before a space that such
    a character follows, and between two such characters' single other white space and the second;
    next to other bytes, which might be white space too, there is none."""
    data = block.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    graph, blank = _GRAPH[data], SPACE[data]
    cut = _inner(data) if inner else np.zeros(len(data) + 1, bool)
    cut[1:-1] |= blank[1:] & graph[:-1]
    cut[:-2] |= (data[:-1] == 0x20) & graph[1:]
    if len(data) > 2:
        cut[2:-1] |= graph[:-2] & blank[1:-1] & (data[1:-1] != 0x20) & graph[2:]
    cut[block.offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values from begins, of the given sizes, in a row."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return values[np.repeat(begins - (upto - sizes), sizes) + np.arange(total)]


class _Half:
    """Ids of segments by hash: an open table with a few tries for each hash."""

    def __init__(self) -> None:
        self.keys, self.begin, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint8)
        self.flat, self.filled, self.entries = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        key = self.keys[at]
        found = np.where(key == hashes, at, -1)
        left = np.flatnonzero((found < 0) & (key != 0))
        for step in range(1, TRIES):
            if not len(left):
                break
            slot = (at[left] + step) & (SLOTS - 1)
            key = self.keys[slot]
            hit = key == hashes[left]
            found[left[hit]] = slot[hit]
            left = left[~hit & (key != 0)]
        return found

    def hold(self, ids: np.ndarray) -> int:
        """Appends ids; returns where they begin."""
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        return self.filled - len(ids)

    def remember(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Enters distinct hashes that are not there yet; the few that find no free slot are not remembered."""
        left = np.flatnonzero((size <= KNOWN_IDS) & (hashes != 0))
        at = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        for step in range(TRIES):
            slot = (at[left] + step) & (SLOTS - 1)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            own = free & (self.keys[slot] == hashes[left])
            self.begin[slot[own]], self.size[slot[own]] = begin[left[own]], size[left[own]]
            self.entries += int(own.sum())
            left = left[~own]


class Encoder:
    def __init__(self, path: str) -> None:
        """Strings of special tokens in a text get those tokens' ids, as is the library's default; such texts go to the library whole."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        #: A special token divides a text into parts that the library encodes each by itself.
        plain = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = plain[0] if plain else None
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values())
        self.opens = np.zeros(self.largest + 1, bool)  # ids with which a spaced word begins
        self.closes = self.opens.copy()  # ids with which a pre-token ends
        for token, i in vocabulary.items():
            self.opens[i], self.closes[i] = token.startswith("Ġ"), token.endswith("</w>")
        lower, upper = self._each([_LETTERS.lower(), _LETTERS])
        self.fold = lower == upper
        self.new, self.old = _Half(), None
        whole = np.array(self._each([_SAMPLE])[0], np.uint32)
        self.cut: Callable | None = None
        for spaced, inner in ((False, True), (False, False), (True, True), (True, False)):
            self.spaced, self.cut = spaced, partial(spaced_words if spaced else bare_words, inner=inner)
            if np.array_equal(self._ids(next(blocks(pa.array([_SAMPLE]))))[0], whole):
                break
        else:
            self.cut = None
        if any(t.normalized for t in added.values()):  # they are met in forms that are not known here
            self.cut = None
        self.new, self.old = _Half(), None

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: str) -> str:
        """The spans as one text, with something between each two."""
        mark = np.frombuffer(between.encode(), np.uint8)
        sizes = ends - starts
        begins = np.concatenate([[0], np.cumsum(sizes + len(mark))])[:-1]
        out = np.tile(mark, -(-int(sizes.sum() + len(mark) * len(sizes)) // max(1, len(mark)))) if len(mark) else np.zeros(int(sizes.sum()), np.uint8)
        out = out[: int(sizes.sum() + len(mark) * len(sizes))]
        if len(mark):
            at = np.repeat(begins + sizes, len(mark)) + np.tile(np.arange(len(mark)), len(sizes))
            out[at] = np.tile(mark, len(sizes))
        out[np.repeat(begins, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = _gathered(data, starts, sizes)
        return out.tobytes().decode()

    def _plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which segments can be told apart in a joined text by their ids alone, and how many pre-tokens those have."""
        count = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
        if self.spaced:  # one space, at the start, before a visible character: each opens with an id of its own
            blanks = count(SPACE[data])
            second = data[np.minimum(starts + 1, len(data) - 1)]
            return (ends - starts > 1) & (data[starts] == 0x20) & _GRAPH[second] & (blanks[ends] - blanks[starts] == 1), np.ones(len(starts), np.int64)
        kind = _CLASS[data]
        known = count(kind > 0)
        new = count(np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == 2))
        return known[ends] - known[starts] == ends - starts, new[ends] - new[starts + 1] + 1

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all segments (in some order) in a row, and where each segment's begin and how many it has."""
        plain, several = self._plain(data, starts, ends)
        call = np.cumsum(ends - starts) // CALL_BYTES
        edges = [0, *(np.flatnonzero(np.diff(call)) + 1).tolist(), len(starts)]
        each = [self._called(data, *(x[a:b] for x in (starts, ends, plain, several))) for a, b in zip(edges[:-1], edges[1:])]
        before = np.cumsum([0, *(len(x[0]) for x in each)]).tolist()
        return np.concatenate([x[0] for x in each]), np.concatenate([x[1] + n for x, n in zip(each, before)]), np.concatenate([x[2] for x in each])

    def _called(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_joined() of so few bytes that the library gets them in one call or two."""
        parts, begin, size = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        filled = 0
        own = np.flatnonzero(plain)
        if len(own):
            ids = np.array(self._each([self._row(data, starts[own], ends[own], "" if self.spaced else " ")])[0], np.uint32)
            if self.spaced:
                bounds = np.concatenate([np.flatnonzero(self.opens[ids]), [len(ids)]])
            else:
                closed = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
                upto = np.concatenate([[0], np.cumsum(several[own])])
                bounds = closed[upto] if len(closed) == upto[-1] + 1 else closed[:0]
            if len(bounds) == len(own) + 1:
                begin[own], size[own] = bounds[:-1], np.diff(bounds)
                parts.append(ids)
                filled = len(ids)
            else:
                plain = np.zeros(len(starts), bool)
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids = np.zeros(0, np.uint32)
            if self.mark:
                ids = np.array(self._each([self._row(data, starts[rest], ends[rest], self.mark[1])])[0], np.uint32)
            at = np.flatnonzero(ids == self.mark[0]) if self.mark else ids
            if len(at) == len(rest):
                bounds = np.concatenate([[0], at + 1])
                begin[rest], size[rest] = filled + bounds[:-1], np.diff(bounds) - 1
            else:
                raw = data.tobytes()
                each = self._each([raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])
                size[rest] = [len(x) for x in each]
                begin[rest] = filled + np.cumsum(size[rest]) - size[rest]
                ids = np.concatenate([np.array(x, np.uint32) for x in each])
            parts.append(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), begin, size

    def _ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block in a row, and where each text's begin (one entry more than texts)."""
        starts, ends = self.cut(block)
        data = LOWER[block.data] if self.fold else block.data
        hashes = span_hashes(data, starts, ends)
        hashes[ends - starts > KNOWN_BYTES] = 0
        slot = self.new.find(hashes)
        begin, size = self.new.begin[slot].astype(np.int64), self.new.size[slot].astype(np.int64)
        missed = np.flatnonzero((slot < 0) | (hashes == 0))
        if len(missed):
            key = np.where(hashes[missed] == 0, starts[missed].astype(np.uint64), hashes[missed])  # a long segment is its own
            _, first, where = np.unique(key, return_index=True, return_inverse=True)
            first = missed[first]
            found_begin, found_size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            unknown = np.ones(len(first), bool)
            if self.old is not None:
                held = self.old.find(hashes[first])
                known = np.flatnonzero((held >= 0) & (hashes[first] != 0))
                slots = held[known]
                found_size[known] = self.old.size[slots]
                ids = _gathered(self.old.flat, self.old.begin[slots].astype(np.int64), found_size[known])
                found_begin[known] = self.new.hold(ids) + np.cumsum(found_size[known]) - found_size[known]
                unknown[known] = False
            fresh = np.flatnonzero(unknown)
            if len(fresh):
                ids, at, sizes = self._joined(data, starts[first[fresh]], ends[first[fresh]])
                found_begin[fresh], found_size[fresh] = self.new.hold(ids) + at, sizes
            begin[missed], size[missed] = found_begin[where], found_size[where]
            if self.new.filled < HELD_IDS:
                self.new.remember(hashes[first], found_begin, found_size)
        out = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=out[1:])
        ids = _gathered(self.new.flat, begin, size)
        if self.new.filled >= HELD_IDS:
            self.new, self.old = _Half(), None if self.new.filled > 2 * HELD_IDS else self.new
        elif self.new.entries >= FULL:
            self.new, self.old = _Half(), self.new
        return ids, out[np.searchsorted(starts, block.offsets)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        for block in blocks(column, BLOCK_BYTES):
            raw = block.data.tobytes() if self.added or self.cut is None else b""
            special = any(x in raw for x in self.added)
            if self.cut is not None:
                ids, bounds = self._ids(block)
                bounds = bounds.tolist()
            for k in range(len(block.offsets) - 1):
                if self.cut is None or special:
                    text = raw[block.offsets[k] : block.offsets[k + 1]]
                    if self.cut is None or any(x in text for x in self.added):
                        yield np.array(self._each([text.decode()])[0], np.uint32)
                        continue
                yield ids[bounds[k] : bounds[k + 1]]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; a worker loads each once."""

    def load() -> Encoder:
        made = Encoder(path)
        trim()  # the vocabulary as it was read
        return made

    return hold(f"tokens {path}", load)


def encoded(column: pa.Array, path: str, end: int) -> Iterator[bytes]:
    """The ids of each whole text and the end id, as little-endian unsigned 32-bit integers."""
    tail = np.array([end], "<u4").tobytes()
    for ids in encoder(path).encode(column):
        yield ids.astype("<u4", copy=False).tobytes() + tail


def pieces(text: Column, path: str, end: int, capacity: int, with_ids: bool = True) -> Column:
    """The ids of encoded() in pieces of at most capacity ids: an array of (piece, start, length, ids_crc32, ids).
    Without ids, the last is null and no ids leave the worker."""
    kind = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: binary>>"

    def cut(column: pa.Array) -> pa.Array:
        ends, rows = [0], ([], [], [], [], [])
        for x in encoded(column, path, end):
            step = 4 * capacity
            for k in range(0, len(x), step):
                own = x[k : k + step]
                for to, value in zip(rows, (k // step, k // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None)):
                    to.append(value)
            ends.append(len(rows[0]))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        made = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names=["piece", "start", "length", "ids_crc32", "ids"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    return F.arrow_udf(cut, kind)(text)
