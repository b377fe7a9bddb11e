"""Hard negatives of anchors, found exactly in k-means inverted lists.

Vectors are turned into integers, as in the exact search. Centroids are fitted by k-means on a bounded sample; every row is put in the list of its
nearest centroid, and each list's radius, the largest distance of a row to its centroid, is stored. By Cauchy and Schwarz a list's scores for a
query q lie between q.c - |q| r and q.c + |q| r. Anchors are rows with a stated id; they come to the driver in blocks of bounded size, and each block is
asked in two rounds, of the positives and then of the negatives in the windows that the positives open. A round first visits each
question's lists of the largest upper bounds, as many as hold enough rows, and then, in one more scan, those whose upper bound isn't strictly below the k-th score
found so far; lists whose bounds lie outside the question's window are skipped. A scan reads the visited lists only: the rows are written
sorted by list within each partition, so that Parquet's statistics leave out the pages of other lists. Vectors are never shuffled, so
no list, however full, meets in one task; a task keeps k rows of each question, and a window merges what the tasks kept.

Defined cases: rows with a null id, label or vector, or with a null or infinite component (also if infinite when scaled), take no part; an empty vector
scores 0; vectors of another length than the anchor's are neither its positives nor its negatives, and a row that has the
anchor's id isn't either; anchors, positives and negatives that repeat an id count each; ties go to the smaller id; an anchor without positives, or whose windows are empty, has no rows.
Scores are exact whole numbers whatever the components; those beyond a long count and are reported as its ends. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.state import written
from weftline.llm.text import releasing

#: Rows of a chunk of a list; anchors of a block and their bytes, at most; questions that meet a chunk at once; blocks whose results one written table holds.
CHUNK, BLOCK, BLOCK_BYTES, ASKED, TOGETHER = 2048, 4096, 4 << 20, 512, 16
#: Rows, and their bytes, at most, that centroids are fitted on; centroids at most; turns of k-means.
SAMPLE, SAMPLE_BYTES, LISTS, TURNS = 16384, 16 << 20, 256, 8
#: Rows for each of the k asked for that the lists of a question's first visit hold.
FIRST = 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_COLUMNS = ("question", "anchor_id", "positive_id", "positive_score", "vec_id", "score")
_SCHEMA = ", ".join(f"{c} long" for c in _COLUMNS)


def _usable(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, label, dim, v): the rows that take part, v being whole numbers in doubles."""
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) == float("inf")))
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale))  # larger doubles are whole
    return df.where(fit).select("vec_id", "label", F.size("x").alias("dim"), whole.alias("v"))


def k_means(x: np.ndarray, k: int, turns: int = TURNS, seed: int = 11) -> np.ndarray:
    """k centroids, at most, of the rows of x."""
    rnd = np.random.default_rng(seed)
    c = np.unique(x[rnd.permutation(len(x))[:k]], axis=0)
    for _ in range(turns):
        near = _nearest(x, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and the distance to it."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        near = np.nan_to_num(far, nan=np.inf).argmin(1)
        return near, np.sqrt(((x - c[near]) ** 2).sum(1))


@dataclass
class Lists:
    """The inverted lists of vectors: rows (dim, list, vec_id, label, v), and by length the centroids, radii and sizes of the lists."""

    rows: DataFrame
    by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, usable: DataFrame, lists: int | None = None) -> Lists:
        """lists: centroids; the half of the square root of the rows, LISTS at most, by default. A length that the sample lacks has one list around 0."""
        size = usable.agg(F.count("*"), F.max("dim")).first()
        few = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size[1] or 1))))
        sample: dict[int, list] = {}
        for row in usable.select("dim", "v").orderBy(F.xxhash64("vec_id", "v")).limit(few).collect():
            sample.setdefault(row[0], []).append(row[1])
        k = lists or max(1, min(LISTS, int(size[0] ** 0.5 / 2)))
        fitted = {dim: k_means(np.array(v, np.float64).reshape(len(v), dim), k) for dim, v in sample.items()}
        shared = usable.sparkSession.sparkContext.broadcast(fitted)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    batch = whole.slice(at, CHUNK)
                    dims, values = batch.column("dim").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False)
                    starts = np.concatenate(([0], np.cumsum(dims)))
                    near, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
                    for dim in set(dims.tolist()):
                        own = np.flatnonzero(dims == dim)
                        near[own], far[own] = _nearest(values[starts[own][:, None] + np.arange(dim)], shared.value.get(dim, np.zeros((1, dim))))
                    yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(near), pa.array(far), batch.column("vec_id"), batch.column("label"), batch.column("v")], names=["dim", "list", "far", "vec_id", "label", "v"])

        rows = written(usable.mapInArrow(releasing(assign), "dim int, list int, far double, vec_id long, label long, v array<double>").sortWithinPartitions("dim", "list"))
        by_dim: dict[int, tuple] = {}
        for dim, k, radius, n in rows.groupBy("dim", "list").agg(F.max("far"), F.count("*")).orderBy("dim", "list").collect():
            c = fitted.get(dim, np.zeros((1, dim)))
            if dim not in by_dim:
                by_dim[dim] = (c, np.zeros(len(c)), np.zeros(len(c), np.int64))
            by_dim[dim][1][k], by_dim[dim][2][k] = radius, n
        return cls(rows, by_dim)

    def bounds(self, dim: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each list of that length can have for each query."""
        c, radius, n = self.by_dim[dim]
        norm = np.linalg.norm(queries, axis=1)[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            middle, reach = queries @ c.T, norm * radius[None, :] * (1 + 1e-9) + 1e-9 * norm * np.linalg.norm(c, axis=1)[None, :] + 1e-6
            low, high = np.nan_to_num(middle - reach, nan=-np.inf, neginf=-np.inf), np.nan_to_num(middle + reach, nan=np.inf, posinf=np.inf)
        low[:, n == 0], high[:, n == 0] = np.inf, -np.inf
        return low, high


@dataclass
class Questions:
    """Questions of anchors of one length. Each asks for the best k rows whose score lies in low..high, of the anchor's label (same) or of others."""

    dim: int
    anchors: np.ndarray  # anchor, component
    ids: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray  # question -> anchor
    number: np.ndarray
    low: list[int | None]
    high: list[int | None]
    same: bool
    positive: list[int]
    positive_score: list[int]

    def least(self) -> np.ndarray:
        return np.array([-np.inf if x is None else float(x) for x in self.low])

    def most(self) -> np.ndarray:
        return np.array([np.inf if x is None else float(x) for x in self.high])


def best_in_windows(asked: Questions, open_: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(question's place, row's place, score) of the k best rows, at most, of each open question; rows scoring less than the question's floor may be
    left out."""
    places = np.flatnonzero(open_)
    empty = np.zeros(0, np.int64)
    if not len(places) or not len(ids):
        return empty, empty, []
    largest = float(np.abs(asked.anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if largest >= 2.0**53:
        return _best_exactly(asked, places, ids, labels, rows, k)
    mine = asked.anchor[places]
    distinct, at = np.unique(mine, return_inverse=True)
    scores = asked.anchors[distinct] @ rows.T
    fits = (labels[None, :] == asked.labels[distinct][:, None]) == asked.same
    fits &= ids[None, :] != asked.ids[distinct][:, None]
    low, high = asked.least()[places], asked.most()[places]
    out_q, out_r, out_s = [], [], []
    for a in range(0, len(places), ASKED):
        part = slice(a, a + ASKED)
        s = scores[at[part]]
        ok = fits[at[part]] & (s >= np.maximum(low[part], floor[places[part]])[:, None]) & (s <= high[part][:, None])
        if ok.shape[1] > k and (ok.sum(1) > k).any():
            s = np.where(ok, s, -np.inf)
            ok &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        q, r = np.nonzero(ok)
        out_q.append(places[part][q]), out_r.append(r), out_s.append(s[q, r])
    q, r, s = np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s).astype(np.int64)
    order = np.lexsort((ids[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], r[first], s[first].tolist()


def _best_exactly(asked: Questions, places: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The same in whole numbers of any size."""
    whole = [[int(c) for c in row] for row in rows.tolist()]
    out: list[tuple[int, int, int]] = []
    scores: dict[int, list[int]] = {}
    for place in places.tolist():
        a = int(asked.anchor[place])
        if a not in scores:
            query = [int(c) for c in asked.anchors[a].tolist()]
            scores[a] = [sum(x * y for x, y in zip(query, row, strict=True)) for row in whole]
        low, high = asked.low[place], asked.high[place]
        found = [
            (-s, int(ids[r]), r) for r, s in enumerate(scores[a])
            if (labels[r] == asked.labels[a]) == asked.same and ids[r] != asked.ids[a] and (low is None or s >= low) and (high is None or s <= high)
        ]
        out += [(place, r, -s) for s, _, r in sorted(found)[:k]]
    return np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64), [o[2] for o in out]


def _clipped(x: int) -> int:
    return min(max(x, _LEAST), _MOST)


def _scan(lists: Lists, asked: list[Questions], visits: list[np.ndarray], floors: list[np.ndarray], k: int) -> DataFrame:
    """_COLUMNS: what the visited lists hold for each question, k rows a task at most. visits: question, list; floors: the k-th
    score that is known."""
    shared = lists.rows.sparkSession.sparkContext.broadcast({q.dim: (q, v, f) for q, v, f in zip(asked, visits, floors, strict=True)})
    wanted = F.lit(False)
    for q, v in zip(asked, visits, strict=True):
        wanted |= (F.col("dim") == q.dim) & F.col("list").isin(np.flatnonzero(v.any(0)).tolist())
    types = [pa.int64()] * len(_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, dict[int, list[tuple[int, int]]]] = {dim: {} for dim in shared.value}
        known = {dim: f.copy() for dim, (_, _, f) in shared.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                dims, names = batch.column("dim").to_numpy(), batch.column("list").to_numpy()
                ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
                values, starts = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dims)))
                cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(names) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                    dim = int(dims[a])
                    if dim not in kept:
                        continue
                    q, visit, _ = shared.value[dim]
                    rows = values[starts[a] : starts[b]].reshape(b - a, dim)
                    for place, r, s in zip(*best_in_windows(q, visit[:, names[a]], ids[a:b], labels[a:b], rows, k, known[dim]), strict=True):
                        best = kept[dim].setdefault(int(place), [])
                        best.append((-s, int(ids[a + r])))
                        if len(best) > 2 * k:
                            best[:] = sorted(best)[:k]
                            known[dim][place] = max(known[dim][place], -best[-1][0])
        for dim, found in kept.items():
            q = shared.value[dim][0]
            out = [
                (int(q.number[p]), int(q.ids[q.anchor[p]]), q.positive[p], _clipped(q.positive_score[p]), i, _clipped(-s))
                for p, best in found.items() for s, i in sorted(best)[:k]
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(_COLUMNS))

    return lists.rows.where(wanted).mapInArrow(releasing(run), _SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ask(lists: Lists, asked: list[Questions], k: int) -> DataFrame:
    """_COLUMNS and rank: each question's k best rows, by two scans of the lists that can hold them."""
    bounds = [lists.bounds(q.dim, q.anchors) for q in asked]
    visits, open_ = [], []
    for q, (low, high) in zip(asked, bounds, strict=True):
        n = lists.by_dim[q.dim][2]
        low, high = low[q.anchor], high[q.anchor]
        inside = (high >= q.least()[:, None]) & (low <= q.most()[:, None]) & (n > 0)[None, :]
        bound = np.where(inside, np.minimum(high, q.most()[:, None]), -np.inf)
        order = np.lexsort((-high, -bound), axis=1)  # by the best score that the window leaves a list, then by its own bound
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros_like(inside)
        np.put_along_axis(first, order, before < FIRST * k, 1)
        visits.append(first & inside)
        open_.append((inside, high))
    nothing = [np.full(len(q.anchor), -np.inf) for q in asked]
    found = written(_ranked(_scan(lists, asked, visits, nothing, k), k).drop("rank"))
    kth = {r[0]: float(r[1]) for r in found.groupBy("question").agg(F.min("score"), F.count("*").alias("n")).where(F.col("n") >= k).toLocalIterator()}
    floors = [np.array([kth.get(int(x), -np.inf) for x in q.number]) for q in asked]
    rest = [inside & ~first & (high >= floor[:, None]) for (inside, high), first, floor in zip(open_, visits, floors, strict=True)]
    return _ranked(found.unionByName(_scan(lists, asked, rest, floors, k)), k)


def _blocks(usable: DataFrame, every: int) -> Iterator[list[tuple[int, int, int, list[float]]]]:
    """Anchors (vec_id, label, dim, v) in blocks of BLOCK rows and about BLOCK_BYTES at most, partition by partition."""
    held, size = [], 0
    for row in usable.where(F.col("vec_id") % every == 0).toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        size += 8 * row[2] + 64
        if size >= BLOCK_BYTES or len(held) >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _negative_questions(q: Questions, positives: dict[int, list[tuple[int, int]]], base: int, lowest: int) -> Questions:
    """A question for each anchor and positive whose window holds a score: lowest % of the positive's score to all of it."""
    rows = [(a, i, s) for a in range(len(q.ids)) for i, s in positives.get(int(q.number[a]), []) if s >= 0]
    return Questions(
        q.dim, q.anchors, q.ids, q.labels, np.array([r[0] for r in rows], np.int64), base + np.arange(len(rows)), [-(-lowest * s // 100) for _, _, s in rows],
        [s for _, _, s in rows], False, [i for _, i, _ in rows], [s for _, _, s in rows],
    )


def hard_negatives(vectors: DataFrame, k: int = 5, positives: int = 5, every: int = 100, lowest: int = 80, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0, lists: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors: rows whose id is divisible by every; an anchor's
    positives: its best rows of the same label; its negatives for a positive: the k best rows of other labels that score between `lowest`
    percent of the positive's score and all of it. Scores: inner products of floor(scale * component)."""
    usable = _usable(vectors, id_col, label_col, vector_col, scale)
    index = Lists.build(usable, lists)
    found, open_, base = usable.sparkSession.createDataFrame([], _SCHEMA + ", rank int"), 0, 0
    for block in _blocks(usable, every):
        asked = []
        for dim in sorted({r[2] for r in block}):
            rows = [r for r in block if r[2] == dim]
            n = len(rows)
            anchors = np.array([r[3] for r in rows], np.float64).reshape(n, dim)
            asked.append(Questions(dim, anchors, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.arange(n), base + np.arange(n), [None] * n, [None] * n, True, [0] * n, [0] * n))
            base += n
        best: dict[int, list[tuple[int, int]]] = {}
        for row in ask(index, asked, positives).orderBy("question", "rank").toLocalIterator():
            best.setdefault(row["question"], []).append((row["vec_id"], row["score"]))
        windows = []
        for q in asked:
            windows.append(_negative_questions(q, best, base, lowest))
            base += len(windows[-1].number)
        if windows := [q for q in windows if len(q.number)]:
            found, open_ = found.unionByName(ask(index, windows, k)), open_ + 1
        if open_ == TOGETHER:
            found, open_ = written(found), 0
    score = F.col("score").alias("negative_score")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", score)
