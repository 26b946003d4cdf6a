"""Word, line and span scanning of whole Arrow string columns with numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D; as those are ASCII, the scan can
work on UTF-8 bytes.  Spans are named by 64-bit polynomial hashes taken from prefix sums,
so that the cost is a few vector operations a byte, whatever the number of words.
Texts are cut into blocks of a quarter of a megabyte, so memory does not follow the batch size.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_held: dict[str, object] = {}


def hold(name: str, make: Callable[[], object]) -> object:
    """What a worker has made once under a name; it holds one such thing at a time."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Gives back what an earlier operator left in this worker, which Spark uses again for other operators."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(made: Callable) -> Callable:
    """A function of Arrow columns that leaves nothing but its result in the worker, which may be idle for long beside others."""

    @wraps(made)
    def run(*columns):
        try:
            return made(*columns)
        finally:
            trim()

    return run


PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block(NamedTuple):
    """Some consecutive texts: their bytes, and where each begins (one entry more than texts)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """The column in blocks of at most limit bytes, or of a single longer text; null counts as empty."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        array = (array.fill_null("") if array.null_count else array).cast(pa.large_string())
        _, offs, data = array.buffers()
        offsets = np.frombuffer(offs, np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        first = 0
        while first < len(array):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            last = min(last, len(array))
            own = offsets[first : last + 1]
            yield Block(first, data[own[0] : own[-1]], own - own[0])
            first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.full(size, _BASE)])
    down = np.concatenate([one, np.full(size, _BASE_INVERSE)])
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end); spans ascend and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        low, high = starts[at:upto] - base, ends[at:upto] - base
        size = int(high[-1])
        up, down = _powers(1 << max(18, (size - 1).bit_length()))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[base : base + size]] * up[:size], out=sums[1:])
        raw = (sums[high] - sums[low]) * down[low]
        out[at:upto] = mixed(raw + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = upto
    return out


def words(block: Block, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of the block in order: its text's number in the block, and its hash."""
    solid = ~SPACE[block.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[block.offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    data = LOWER[block.data] if lower else block.data
    text = np.searchsorted(block.offsets, starts, "right") - 1
    return text, span_hashes(data, starts, ends)


def windows(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of n words within a text: the text's number and the run's hash."""
    if len(hashes) < n:
        return text[:0], hashes[:0]
    size = len(hashes) - n + 1
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = mixed(h + hashes[i : i + size] * np.uint64(2 * i + 3))
    within = text[:size] == text[n - 1 :]
    return text[:size][within], h[within]


def per_text(block: Block, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask holds."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[block.offsets[1:]] - sums[block.offsets[:-1]]
