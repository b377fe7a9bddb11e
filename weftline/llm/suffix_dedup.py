"""Removal of repeated byte strings, by bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes (100) that covers it also starts earlier: in a text with a
smaller id, or earlier in the same text; strings never cross texts and are judged on the input. The
corpus is cut so that every such string's occurrences meet, without a suffix array of the whole:

1. A window of `length` bytes is anchored at the smallest hash among its 32-byte grams, so equal windows
   have equal anchors. A run of windows with one anchor is a fragment of some 130 bytes. Only fragments
   whose anchor occurs twice go on.
2. Equal fragments are pre-aggregated: all but the first stand for their first.
3. The different fragments of an anchor meet in a transform: from the sorted suffixes of a few hundred
   KB, intervals of rows are extended backwards, breadth first, from the empty string on; the boundaries
   that strings of k + 1 bytes find have common prefixes of k bytes. After `length` turns the
   boundaries that were never found separate nothing: rows between two found ones share `length` bytes.
   In each such class all windows but the first are repeats.
4. An anchor with more than MANY different fragments (the edges of a passage that very many texts share)
   isn't collected: its windows are settled by their hash, in each task and then in buckets of hashes.

Defined cases: a null text is an empty one; nothing of a text shorter than `length` goes; rows without an
id come after all others; rows that repeat an id and text are one document, each with its result; further
rows of one id are ordered by the start alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.state import Bitmap, small_batches, written
from weftline.llm.text import U64, mix, prefix_hash, releasing, span_hash, text_bytes, text_slices

GRAM = 32
#: Different fragments of one anchor beyond which its windows are settled by their hash.
MANY = 256
#: Bytes of fragments that one transform holds, but for an anchor's last ones.
TRANSFORM = 400_000
_LAST = (1 << 63) - 1


class _Fragments:
    """The fragments of a slice: arrays row, start, stop (in the slice), windows, anchor and content hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int):
        self.prefix = prefix_hash(raw)
        self.row = self.start = self.windows = np.zeros(0, np.int64)
        self.anchor = self.content = np.zeros(0, np.uint64)
        sizes = np.maximum(np.diff(offsets) - length + 1, 0)
        if not sizes.sum():
            return
        grams = span_hash(self.prefix, np.arange(len(raw) - GRAM + 1), np.arange(GRAM, len(raw) + 1))
        bits = U64(len(raw).bit_length())
        packed = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
        span = length - GRAM + 1
        padded = np.full(-(-len(packed) // span) * span + span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(packed)] = packed
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        rows = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(rows)) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        anchors = np.minimum(behind[at], ahead[at + span - 1]) & ((U64(1) << bits) - U64(1))
        first = np.ones(len(at), bool)
        first[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
        begin = np.flatnonzero(first)
        self.windows = np.diff(begin, append=len(at))
        self.row, self.start = rows[begin], at[begin]
        self.anchor = grams[anchors[begin].astype(np.int64)]
        self.content = span_hash(self.prefix, self.start, self.start + self.windows + length - 1)


def suffix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all suffixes, sorted by their first `length` symbols, and each one's class: suffixes of one
    class share `length` symbols. text: uint16 symbols below 512; 0 ends a string, and suffixes that reach a
    0 within `length` symbols have no defined class."""
    n = len(text)
    order = _sorted_suffixes(text, length)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # the row of the suffix that starts one symbol earlier
    step[by_symbol] = np.arange(n)
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    ends = np.cumsum(np.bincount(before, minlength=1))
    low, high = np.concatenate(([0], ends[:-1])), ends
    keep = high > low
    low, high = low[keep], high[keep]
    for turn in range(length):
        if turn:
            single = high - low == 1
            rows = low[single]
            rows = step[rows[before[rows] > 0]]
            wide_low, sizes = low[~single], (high - low)[~single]
            if len(sizes):
                owner = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(owner)) + np.repeat(wide_low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
                symbol = before[at].astype(np.int64)
                at, key = at[symbol > 0], (owner * 512 + symbol)[symbol > 0]
                sort = np.argsort(key, kind="stable")
                at, key = at[sort], key[sort]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                wide = step[at[first]]
                low, high = np.concatenate((rows, wide)), np.concatenate((rows + 1, wide + np.diff(first, append=len(key))))
            else:
                low, high = rows, rows + 1
        new = ~found[high]
        low, high = low[new], high[new]
        found[high] = True
        if not len(low):
            break
    return order, np.cumsum(found[:n])


def _sorted_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Suffix starts sorted by their first `length` symbols, by doubling the sorted depth."""
    n, depth = len(text), 7
    padded = np.concatenate((text.astype(np.uint64), np.zeros(depth, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(min(depth, length)):
        key = (key << U64(9)) | padded[k : n + k]
    while True:
        order = np.argsort(key)
        if depth >= length:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1]))).astype(np.uint64) + U64(1)
        ahead = min(depth, length - depth)
        later = np.zeros(n, np.uint64)
        later[: n - ahead] = rank[ahead:]
        key = rank * U64(n + 2) + later
        depth += ahead


def repeated_spans(fragments: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(fragment, first, stop): the maximal runs of windows, counted from the fragment's start, that occur earlier
    among the fragments. doc and start place the fragments' first bytes."""
    sizes = np.array([len(f) for f in fragments])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    body = np.ones(len(text), bool)
    body[begin + sizes] = False
    text[body] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.uint16) + 1
    order, classes = suffix_classes(text, length)
    of = np.empty(len(text), np.int64)
    of[order] = classes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
    kind = of[begin[owner] + inside]
    by = np.lexsort((start[owner] + inside, doc[owner], kind))
    repeat = np.zeros(len(owner), bool)
    repeat[by[1:]] = kind[by[1:]] == kind[by[:-1]]
    edge = repeat.copy()
    edge[1:] = repeat[1:] & (~repeat[:-1] | (owner[1:] != owner[:-1]))
    stop = repeat.copy()
    stop[:-1] = repeat[:-1] & (~repeat[1:] | (owner[1:] != owner[:-1]))
    a, b = np.flatnonzero(edge), np.flatnonzero(stop)
    return list(zip(owner[a].tolist(), inside[a].tolist(), (inside[b] + 1).tolist(), strict=True))


def _place(doc: np.ndarray, start: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(content ^ mix(doc.view(np.uint64) * U64(0x9E3779B97F4A7C15) + start.view(np.uint64)))


def _scan(docs: DataFrame, what: str, length: int, kept: Bitmap | None = None) -> DataFrame:
    """what: "anchors" gives every fragment's anchor; "fragments" the fragments whose anchor is kept; "texts"
    the bytes of the fragments whose place is kept."""
    fields = {"anchor": pa.int64(), "content": pa.int64(), "doc": pa.int64(), "row": pa.int64(), "start": pa.int64(), "windows": pa.int32(), "place": pa.int64()}
    if what == "anchors":
        fields = {"anchor": pa.int64()}
    elif what == "texts":
        fields |= {"bytes": pa.binary()}
    schema = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                raw, offsets = text_bytes(batch.column("text"))
                f = _Fragments(raw, offsets, length)
                if not len(f.row):
                    continue
                if what == "anchors":
                    yield pa.RecordBatch.from_arrays([pa.array(f.anchor.view(np.int64))], schema=schema)
                    continue
                doc, name = batch.column("doc").to_numpy()[f.row], batch.column("row").to_numpy()[f.row]
                start = f.start - offsets[:-1][f.row]
                place = _place(doc, start, f.content)
                hit = np.flatnonzero(kept.holds(f.anchor if what == "fragments" else place))
                columns = [f.anchor.view(np.int64), f.content.view(np.int64), doc, name, start, f.windows.astype(np.int32), place.view(np.int64)]
                columns = [pa.array(c[hit]) for c in columns]
                if what == "texts":
                    columns.append(pa.array([raw[a : a + n + length - 1].tobytes() for a, n in zip(f.start[hit], f.windows[hit], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return docs.mapInArrow(releasing(run), ", ".join(f"{k} {kinds[v]}" for k, v in fields.items()))


_SPANS = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_SPANS_SQL = "doc long, row long, start long, stop long"


def _transformed(texts: DataFrame, length: int) -> DataFrame:
    """The repeats among the different fragments of each anchor."""

    def spans(held: list[tuple]) -> pa.RecordBatch:
        doc, row, start, data = zip(*held, strict=True)
        found = repeated_spans(list(data), np.array(doc), np.array(start), length)
        return pa.RecordBatch.from_arrays([pa.array([doc[k] for k, _, _ in found], pa.int64()), pa.array([row[k] for k, _, _ in found], pa.int64()), pa.array([start[k] + a for k, a, _ in found], pa.int64()), pa.array([start[k] + b + length - 1 for k, _, b in found], pa.int64())], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for anchor, *entry in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "row", "start", "bytes")), strict=True):
                if size >= TRANSFORM and anchor != last:
                    yield spans(held)
                    held, size = [], 0
                held.append(entry)
                size += len(entry[-1])
                last = anchor
        if held:
            yield spans(held)

    return texts.select("anchor", "doc", "row", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(releasing(run), _SPANS_SQL)


def _later(window: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that occur earlier among these, and the first ones."""
    by = np.lexsort((start, doc, window))
    repeat = window[by[1:]] == window[by[:-1]]
    return by[1:][repeat], by[np.concatenate(([True], ~repeat))[: len(by)]]


def _runs(doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """doc, row, start and stop of the runs of successive windows."""
    by = np.lexsort((start, row, doc))
    doc, row, start = doc[by], row[by], start[by]
    edge = np.ones(len(by), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(edge)
    last = np.concatenate((first[1:], [len(by)]))[: len(first)] - 1
    return [doc[first], row[first], start[first], start[last] + length]


def _counted(texts: DataFrame, length: int) -> DataFrame:
    """The repeats among fragments that are too many to meet: by the windows' hashes. A task settles what repeats
    within its own windows; the first ones of all tasks meet in buckets of hashes, packed."""
    size = texts.agg(F.sum("windows")).first()[0] or 0
    bits = max(9, int(size // 100_000).bit_length())
    schema = pa.schema([*_SPANS, ("bucket", pa.int64()), ("packed", pa.binary())])

    def settled(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        window, doc, row, start = (np.concatenate(c) for c in zip(*held, strict=True))
        later, first = _later(window, doc, start)
        spans = _runs(doc[later], row[later], start[later], length)
        bucket = (window[first] >> U64(64 - bits)).astype(np.int64)  # in order, as the windows are
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
        packed = np.stack([c[first].view(np.int64) for c in (window, doc, row, start)], 1)
        n, m = len(spans[0]), len(edges) - 1
        columns = [pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(m, pa.int64())]) for c in spans]
        columns.append(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(bucket[edges[:-1]])]))
        columns.append(pa.array([None] * n + [packed[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for batch in text_slices(whole, "bytes"):
                raw, offsets = text_bytes(batch.column("bytes"))
                sizes = np.diff(offsets) - length + 1
                owner = np.repeat(np.arange(len(sizes)), sizes)
                inside = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
                at = offsets[:-1][owner] + inside
                held.append([span_hash(prefix_hash(raw), at, at + length), *(batch.column(c).to_numpy()[owner] for c in ("doc", "row")), batch.column("start").to_numpy()[owner] + inside])
                n += len(owner)
                if n >= 1_000_000:
                    yield settled(held)
                    held, n = [], 0
        if n:
            yield settled(held)

    def meet(bucket: pa.Table) -> pa.Table:
        packed = np.concatenate([np.frombuffer(b, np.int64) for b in bucket.column("packed").to_pylist()]).reshape(-1, 4)
        later, _ = _later(packed[:, 0], packed[:, 1], packed[:, 3])
        return pa.table([pa.array(c, pa.int64()) for c in _runs(packed[later, 1], packed[later, 2], packed[later, 3], length)], schema=_SPANS)

    both = written(texts.mapInArrow(releasing(run), f"{_SPANS_SQL}, bucket long, packed binary"))
    return both.where("packed is null").select(*_SPANS.names).unionByName(both.where("packed is not null").select("bucket", "packed").groupBy("bucket").applyInArrow(meet, _SPANS_SQL))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining
    bytes and, if with_text, these bytes as kept. length: at least 32 bytes."""
    small_batches(docs.sparkSession)
    if length < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes are needed")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")

    anchors = written(_scan(docs, "anchors", length).groupBy("anchor").count().where("count > 1").select("anchor"))
    fragments = written(_scan(docs, "fragments", length, Bitmap(anchors, "anchor", anchors.count())))
    firsts = written(fragments.groupBy("anchor", "content").agg(F.min(F.struct("doc", "start", "place")).alias("first"), F.count("*").alias("n")))
    repeats = fragments.join(firsts.where("n > 1"), ["anchor", "content"]).where("doc <> first.doc or start <> first.start")
    spans = repeats.select("doc", "row", "start", (F.col("start") + F.col("windows") + length - 1).alias("stop"))

    several = firsts.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1")
    places = written(firsts.join(several, "anchor").select(F.col("first.place").alias("place"), "different"))
    texts = _scan(docs, "texts", length, Bitmap(places, "place", places.count()))
    texts = written(texts.join(places, "place").dropDuplicates(["place", "row"]))
    spans = spans.unionByName(_transformed(texts.where(F.col("different") <= MANY), length))
    spans = spans.unionByName(_counted(texts.where(F.col("different") > MANY), length))
    spans = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data, kept, at, runs = (text or "").encode(), [], 0, 0
                for a, b in sorted((s["start"], s["stop"]) for s in gone or ()):
                    if a > at or not runs:
                        kept.append(data[at:a])
                        runs += 1
                    at = max(at, b)
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest)[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    joined = docs.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(releasing(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
