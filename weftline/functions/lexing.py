"""Vectorised lexing of Arrow text columns: tokens that cover each text, with their places, in numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 1 << 20
_WORD, _NEWLINE, _SPACE, _OTHER, _INSIDE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F]] = _WORD
_KIND[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
_KIND[0x0A] = _NEWLINE
_KIND[0x80:0xC0] = _INSIDE  # of a character of several bytes


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of whole rows with about limit bytes of text at most, or one longer row."""
    sizes = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = array.cast(pa.string()).fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lexed(array: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Each token's row, and its idx, value, start, stop, line and col: 0-based offsets in characters, 1-based lines and columns."""
    raw, offsets = _raw(array)
    kind = _KIND[raw]
    lead = kind != _INSIDE
    begins = lead & (kind == _OTHER)
    begins[1:] |= lead[1:] & (kind[1:] != kind[:-1])
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    at = np.flatnonzero(begins)
    edges = np.append(at, len(raw))
    row = np.searchsorted(offsets, at, "right") - 1
    base = offsets[row]
    chars = np.concatenate(([0], np.cumsum(lead)))
    breaks = np.flatnonzero(kind == _NEWLINE)
    before = np.searchsorted(breaks, at)
    line_start = np.maximum(base, np.append(breaks, -1)[before - 1] + 1) if len(breaks) else base
    line = 1 + before - np.searchsorted(breaks, base)
    line_start = np.where(line > 1, line_start, base)
    idx = np.arange(len(at)) - np.searchsorted(at, base)
    value = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw))
    numbers = (chars[at] - chars[base], chars[edges[1:]] - chars[base], line, 1 + chars[at] - chars[line_start])
    return row, [pa.array(idx.astype(np.int32)), value, *(pa.array(n.astype(np.int64)) for n in numbers)]
