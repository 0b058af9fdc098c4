"""Words of whole texts as 64-bit hashes, vectorised over Arrow batches.

A text is read as UTF-8 bytes with A-Z lower-cased. All separators are ASCII, so cutting bytes equals cutting
characters. Hashes are sums of random byte values times powers of an odd number, then mixed: equal words have
equal hashes, and different words collide with a probability of about 2**-58 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18        # bytes hashed at a time, each with several numbers of 8 bytes
SLICE = 4 << 20        # bytes of text handled at a time; a longer text is a slice of its own
_ODD = 0x9E3779B97F4A7C15 | 3
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF)):
    NON_ALNUM[_first:_last + 1] = False    # A-Z are words once lower-cased

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWERED = _BYTE[_LOWER]

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in runs of about ``limit`` bytes; null texts become empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more at the end)."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _blocks(raw: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end before a separator (or at the end)."""
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + BLOCK)
        while stop < len(raw):
            found = np.flatnonzero(separators[raw[stop:stop + 65536]])
            if len(found):
                stop += int(found[0])
                break
            stop = min(len(raw), stop + 65536)
        yield at, stop
        at = stop


def hashed(raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES,
           spans: bool = False) -> tuple[np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (one more at the end); with ``spans`` also
    the first byte of each word and the byte after it."""
    hashes, starts, stops = [], [], []
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    for lo, hi in _blocks(raw, separators):
        part = raw[lo:hi]
        word = ~separators[part]
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = word[:-1]
        edge = cut[lo:hi + 1]
        begins = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LOWERED[part] * _power(_ODD, len(part), "up"), out=sums[1:])
        h = (sums[ends] - sums[begins]) * _power(pow(_ODD, -1, 1 << 64), len(part), "down")[begins]
        hashes.append(mix(h + (ends - begins).astype(np.uint64)))
        starts.append(begins + lo)
        stops.append(ends + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    offsets = np.searchsorted(first, at, side="left")
    if spans:
        return h, offsets, first, np.concatenate(stops) if stops else np.zeros(0, np.int64)
    return h, offsets


def span_hashes(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes, never 0, of the bytes of ascending spans; unlike words' they tell A-Z from a-z."""
    out = np.empty(len(begins), np.uint64)
    ends = begins + sizes
    at = 0
    while at < len(begins):
        lo = int(begins[at])
        stop = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, side="right")))
        part = raw[lo:int(ends[stop - 1])]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _power(_ODD, len(part), "up"), out=sums[1:])
        a = begins[at:stop] - lo
        h = sums.take(ends[at:stop] - lo)
        h -= sums.take(a)
        h *= _power(pow(_ODD, -1, 1 << 64), len(part), "down").take(a)
        out[at:stop] = mix(h + sizes[at:stop].astype(np.uint64))
        at = stop
    return np.maximum(out, np.uint64(1))


def sequence_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive hashes."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(length):
        out += h[j:j + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(out)


def windows(h: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``length``-word windows inside each text and where each text's begin; a text with fewer
    words, but not none, has one window of all its words."""
    counts = np.diff(offsets)
    n = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(at[-1], np.uint64)
    full = sequence_hash(h, length)
    long = counts >= length
    take = np.repeat(offsets[:-1][long] - at[:-1][long], n[long]) + np.flatnonzero(np.repeat(long, n))
    out[np.repeat(long, n)] = full[take]
    for row in np.flatnonzero((counts > 0) & ~long):
        out[at[row]] = sequence_hash(h[offsets[row]:offsets[row + 1]], int(counts[row]))[0]
    return out, at


def text_batch(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only


def give_back() -> None:
    """Gives freed memory back to the system, which Arrow and the C library else keep."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(run: Callable[..., Iterator[pa.RecordBatch]]):
    """``run``, giving memory back at the end of each task: a worker outlives its task, beside those of the next stage."""
    @wraps(run)
    def ended(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            give_back()
    return ended
