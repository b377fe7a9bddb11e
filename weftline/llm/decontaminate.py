"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item is found in a document that holds at least 80 % of the item's distinct five-word shingles.
Items are partitioned by the size of their sets into classes up to u = 1, 2, 4, ... shingles. For each
class the documents are searched in windows of 2u shingles, a window every u, so that a short item is as
large a part of a window in a long document as in a short one: by MinHash signatures of FUNCTIONS values,
of which one equal value makes a candidate (at a containment of 0.8 one in 10**11 is missed at most).
Only windows that hold some item's shingle are signed; others can't share a minimum with an item.
Candidates are verified by their exact containment in the whole document.

Items are broadcast in blocks of at most BLOCK_CHARS characters of text; a larger benchmark takes several
passes. Defined cases: null and empty items and items of white space are in no document, null and empty
documents hold none; an item of fewer than five words is one shingle, and only a document of the same
words holds it; repeated rows give one result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.state import small_batches
from weftline.llm.text import U64, mix, releasing, shingle_sets, shingles, text_bytes, text_slices, word_hashes

FUNCTIONS = 128
BLOCK_CHARS = 8_000_000
_seeds = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set of shingles."""
    return np.array([mix(hashes * seed).min() for seed in _seeds], np.uint64)


class ItemIndex:
    """The signatures of a block of items by size class, and their exact sets."""

    def __init__(self, texts: list[str | None], width: int):
        self.sets = shingle_sets(pa.array(texts, pa.string()), width)
        self.all = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        # a coarse table of the items' shingles, looked up before the exact one
        self.bits = max(16, int(len(self.all) * 32).bit_length())
        self.coarse = np.zeros(1 << self.bits, bool)
        self.coarse[(self.all >> U64(64 - self.bits)).astype(np.int64)] = True
        by_class: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                by_class.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        self.classes = {}
        for size, items in sorted(by_class.items()):
            keys = np.concatenate([self._keys(signature(self.sets[k])) for k in items])
            owners = np.repeat(np.array(items), FUNCTIONS)
            order = np.argsort(keys, kind="stable")
            self.classes[size] = keys[order], owners[order]

    @staticmethod
    def _keys(values: np.ndarray) -> np.ndarray:
        return mix(values + np.arange(FUNCTIONS, dtype=np.uint64) * U64(0xD1B54A32D192ED03))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where a shingle of any item stands."""
        near = np.flatnonzero(self.coarse[(hashes >> U64(64 - self.bits)).astype(np.int64)])
        if not len(near):
            return near
        at = np.searchsorted(self.all, hashes[near])
        at[at == len(self.all)] = 0
        return near[self.all[at] == hashes[near]]

    def candidates(self, hashes: np.ndarray, places: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the document's shingles."""
        found: set[int] = set()
        for size, (keys, owners) in self.classes.items():
            last = max(0, -(-len(hashes) // size) - 2)
            starts = np.unique(np.clip(np.concatenate((places // size, places // size - 1)), 0, last))
            for k in starts.tolist():
                own = self._keys(signature(hashes[k * size : (k + 2) * size]))
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    found.update(owners[a:b].tolist())
        return found

    def holdings(self, hashes: np.ndarray, places: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the document holds."""
        if not len(places):
            return []
        hits = np.unique(hashes[places])
        out = []
        for k in sorted(self.candidates(hashes, places)):
            shared = int(np.isin(self.sets[k], hits, assume_unique=True).sum())
            if 100 * shared >= percent * len(self.sets[k]):
                out.append((k, shared))
        return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])


def _search(docs: DataFrame, items: list, percent: int, width: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast((ItemIndex([r["text"] for r in items], width), [r["item_id"] for r in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = index.value
        for whole in batches:
            for batch in text_slices(whole):
                out = [
                    (doc_id, names[k], len(own.sets[k]), shared, shared / len(own.sets[k]))
                    for doc_id, held in zip(batch.column("doc_id").to_pylist(), _held(batch, own, percent, width), strict=True) for k, shared in held
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return docs.mapInArrow(releasing(run), "doc_id long, item_id long, n_item long, n_shared long, containment double")


def _held(batch: pa.RecordBatch, index: ItemIndex, percent: int, width: int) -> list[list[tuple[int, int]]]:
    """For each row the items that its text holds."""
    hashes, rows = shingles(*word_hashes(*text_bytes(batch.column("text"))), width)
    places = index.places(hashes)
    owner = np.searchsorted(rows, places, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
    for row in np.unique(owner).tolist():
        out[row] = index.holdings(hashes[rows[row] : rows[row + 1]], places[owner == row] - rows[row], percent)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The distinct items, collected in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text") + 16)).first()[0] or 0) // BLOCK_CHARS))
    for block in range(blocks):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, that hold no item; null and empty texts hold none, and without items all rows stay. Narrow."""
    small_batches(docs.sparkSession)
    for part in _blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([r["text"] for r in part], width))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in text_slices(whole):
                    yield batch.filter(pa.array([not held for held in _held(batch, index.value, percent, width)], pa.bool_()))

        docs = docs.mapInArrow(releasing(run), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): the benchmark's items (item_id, text) that documents
    hold, as distinct rows. percent: the least containment; width: words of a shingle."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for part in _blocks(benchmark):
        found = _search(docs, part, percent, width)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
