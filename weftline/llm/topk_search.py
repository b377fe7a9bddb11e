"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are turned into integers. At each resolution, coarse to fine, a vector is cut into segments, of
which the mean and the deviation are kept; for a query q and a row x the sum over segments of
length * (mean q * mean x + deviation q * deviation x) bounds the inner product from above, as the same
statistics bound the distance |q|^2 + |x|^2 - 2 qx from below. Rows whose bound stays under a query's
k-th best score so far leave; the others go to the next resolution, and the survivors get exact scores.

The stated queries come to the driver in blocks of bounded size. Each block is broadcast and meets all rows in one narrow scan, in
which a task keeps k rows for each query; what the tasks kept is merged by a window. Vectors are never copied or shuffled, and
the best rows so far bound the next chunk's. Defined cases: vectors that are null, hold a null or a component that isn't finite,
and rows without an id, take no part; an empty vector scores 0; vectors of another length than a query's aren't its candidates;
rows that repeat an id are candidates of their own, but not of the queries with that id; ties go to the smaller id. Scores
are exact whole numbers whatever the components; those beyond a long are reported as its ends.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.state import written
from weftline.llm.text import releasing

#: Rows of a chunk; queries of a block, and their bytes, at most; blocks whose results one written table holds.
CHUNK, BLOCK, BLOCK_BYTES, TOGETHER = 2048, 8192, 4 << 20, 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_RESOLUTIONS = (4, 8, 16, 32)


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a dot product of two rows is the bound."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    scale = np.sqrt([p.shape[1] for p in parts])
    return np.hstack((np.stack([p.mean(1) for p in parts], 1) * scale, np.stack([p.std(1) for p in parts], 1) * scale))


def _exact(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole numbers in doubles, exactly."""
    q = [int(c) for c in query]
    return [sum(a * int(b) for a, b in zip(q, row, strict=True)) for row in rows]


def top_scores(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: list[int | None] | None = None) -> Iterator[tuple[int, list[int], list[int]]]:
    """(query's index, row ids, scores): each query's k best rows of other ids, best first, ties to the smaller id. queries and rows: whole
    numbers, as float64. floor: a query's k-th best score so far, or none; rows under it may be left out."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    largest = float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1]), float(np.abs(rows).max(initial=0))
    plain = largest[0] * largest[1] < 2**53  # sums in doubles are exact
    levels = [s for s in _RESOLUTIONS if 2 * s < rows.shape[1]] if largest[0] < 1e150 and largest[1] < 1e150 else []
    mine, theirs = [_statistics(queries, s) for s in levels], [_statistics(rows, s) for s in levels]
    slack = 1e-9 * (largest[0] + 1) * (largest[1] + 1) + 1e-6
    coarse = mine[0] @ theirs[0].T if levels else None
    for q in range(len(queries)):
        other = row_ids != query_ids[q]
        least = -np.inf if floor is None or floor[q] is None else float(floor[q])
        if coarse is None:
            left = np.flatnonzero(other)
        else:
            bound = np.where(other, coarse[q], -np.inf)
            if np.count_nonzero(other) > k:  # the rows with the best bounds give a first k-th score
                first = np.argpartition(bound, -k)[-k:]
                least = max(least, (rows[first] @ queries[q]).min())
            left = np.flatnonzero(other & (bound >= least - slack))
            for level in range(1, len(levels)):
                if len(left) <= 4 * k:
                    break
                bound = theirs[level][left] @ mine[level][q]
                first = left[np.argpartition(bound, -k)[-k:]]
                least = max(least, (rows[first] @ queries[q]).min())
                left = left[bound >= least - slack]
        if plain:
            scores = (rows[left] @ queries[q]).astype(np.int64)
            best = np.lexsort((row_ids[left], -scores))[:k]
            yield q, row_ids[left][best].tolist(), scores[best].tolist()
        else:
            found = sorted(zip((-s for s in _exact(rows[left], queries[q])), row_ids[left].tolist(), strict=True))[:k]
            yield q, [i for _, i in found], [-s for s, _ in found]


def _numbers(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, dim, v): usable vectors as arrays of whole numbers in doubles; one that is infinite when scaled isn't usable."""
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    usable = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) == float("inf")))
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale))  # larger doubles are whole
    return df.where(usable).select("vec_id", F.size("x").alias("dim"), whole.alias("v"))


def _blocks(numbers: DataFrame, every: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries in blocks of BLOCK rows and about BLOCK_BYTES at most, partition by partition: by length their ids and vectors."""
    held: dict[int, list] = {}
    size = n = 0

    def block() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {dim: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.float64).reshape(len(rows), dim)) for dim, rows in held.items()}

    for vec_id, dim, v in numbers.where(F.col("vec_id") % every == 0).toLocalIterator(prefetchPartitions=True):
        held.setdefault(dim, []).append((vec_id, v))
        size, n = size + 8 * dim + 64, n + 1
        if size >= BLOCK_BYTES or n >= BLOCK:
            yield block()
            held, size, n = {}, 0, 0
    if held:
        yield block()


def _search(numbers: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(query_id, vec_id, score): of each task's rows the k best for each query of the block."""
    shared = numbers.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[list[tuple[int, int]]]] = {dim: [[] for _ in ids] for dim, (ids, _) in shared.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                ids, dims = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy()
                values, offsets = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dims)))
                for dim in set(dims.tolist()) & best.keys():
                    own = np.flatnonzero(dims == dim)
                    rows = values[offsets[own][:, None] + np.arange(dim)]
                    names, queries = shared.value[dim]
                    kept = best[dim]
                    floor = [-b[-1][0] if len(b) == k else None for b in kept]
                    for q, found, scores in top_scores(queries, names, rows, ids[own], k, floor):
                        kept[q] = sorted([*kept[q], *((-s, i) for s, i in zip(scores, found, strict=True))])[:k]
        out = [(int(name), i, min(max(-s, _LEAST), _MOST)) for dim, kept in best.items() for name, b in zip(shared.value[dim][0], kept, strict=True) for s, i in b]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return numbers.mapInArrow(releasing(run), "query_id long, vec_id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a row whose id is divisible by `every`, its k best rows
    by the inner product of floor(scale * component). Rows that repeat a query's id ask together."""
    numbers = _numbers(vectors, id_col, vector_col, scale)
    none = numbers.where("false").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score"))
    found, open_ = none, 0
    for block in _blocks(numbers, every):
        found, open_ = found.unionByName(_search(numbers, block, k)), open_ + 1
        if open_ == TOGETHER:
            found, open_ = written(_merged(found, k).drop("rank")), 0
    return _merged(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
