"""Vectorised views of an Arrow string column: bytes, words, 64-bit word and shingle hashes.

Everything here works on slices of a record batch that hold a few MB of text, so that a worker's
memory doesn't depend on the batch or partition size (one very long text is one slice of its own).
Hashes are 64-bit and stand for the strings they are made from: two different strings of a corpus
share one with a probability of about 2**-56, and a run never depends on Python's own hash().
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_WIDTH = 5
U64 = np.uint64
_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_MULTIPLIERS = _random.integers(1, 2**63, 8, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C13 | 1  # odd, 3 modulo 8: powers differ in their low bits as little as they can
_INVERSE = pow(_BASE, -1, 2**64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"n": 0}
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  other C libraries lack it
except (OSError, AttributeError):
    _libc = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the result depends on every bit of x."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def release() -> None:
    """Gives a worker's unused memory back to the system: workers outlive their tasks, and the next stage has workers of its own needs."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def releasing(run: Callable) -> Callable:
    """An Arrow function, run(batches), that gives memory back when its task begins, what other stages had sent to the worker, and ends."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return whole


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of whole rows with at most limit bytes of text, or one longer row."""
    if not batch.num_rows:
        return
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], np.int32 if pa.types.is_string(array.type) or pa.types.is_binary(array.type) else np.int64)[array.offset : array.offset + len(array) + 1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the rows' offsets in them, from 0; a null is an empty text."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-white bytes, and each row's range among them."""
    white = WHITE[raw]
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = True
    after[filled[1:] - 1] = True
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(raw: np.ndarray, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash; span_hash() takes any span's hash from them."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLDED if folded else _BYTE)[raw] * up[:-1], out=sums[1:])
    return sums, down


def span_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = prefix
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and each row's range among them."""
    starts, ends, rows = words(raw, offsets)
    return span_hash(prefix_hash(raw, folded=True), starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = _WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words, row by row (a shorter row's whole sequence is its one
    shingle, an empty row has none), and each row's range among them. Repeats are kept."""
    counts = np.diff(rows)
    full = np.maximum(counts - width + 1, 0)
    sizes = np.where((counts > 0) & (full == 0), 1, full)
    out_rows = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(out_rows[-1], np.uint64)
    if len(hashes) >= width:
        windows = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            windows += hashes[k : len(windows) + k] * _MULTIPLIERS[k]
        at = np.repeat(rows[:-1] - out_rows[:-1], sizes) + np.arange(len(out))
        long = np.repeat(full > 0, sizes)
        out[long] = mix(windows[at[long]])
    for row in np.flatnonzero((counts > 0) & (full == 0)):
        short = hashes[rows[row] : rows[row + 1]]
        value = (short * _MULTIPLIERS[: len(short)]).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(short), np.uint64) * _MULTIPLIERS[7]
        out[out_rows[row]] = mix(value ^ U64(0xA5A5A5A5))[0]
    return out, out_rows


def shingle_sets(array: pa.Array, width: int = _WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each row."""
    raw, offsets = text_bytes(array)
    values, rows = shingles(*word_hashes(raw, offsets), width)
    return [np.unique(values[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
