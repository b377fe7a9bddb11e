"""N-gram Jaccard self-join by T-occurrence search, and the components of its links.

A text's set is its distinct runs of five words (A-Z lower-cased; fewer words: the whole sequence); two
texts link when they share at least 80 % of the union of their sets. The steps:

1. Texts with one set form a class (a hash of the set); all further steps see classes only, so copies
   cost one row each, whatever their number.
2. Every set is ordered alike, often repeated shingles last. Two linked sets share some of the first
   ones: of the first n - ceil(0.8 n) + m(n), at least m of the smaller one, with m(n) = 1 + n // 12. Only
   shingles that two classes have there are kept, as inverted lists, and only of classes with enough of them.
3. Each class is searched against its hub: of the most central members of its lists (those whose shingles
   most others share), the one that it shares most with. Hubs make clusters of classes, and links components.
4. In a cluster that holds several components, the members outside the largest one are searched against all
   members, so that a large group of near copies never yields its pairs. Of two clusters that share early shingles,
   the members of the smaller one that share enough with the larger one are searched against it. A cluster answers
   all its queries at once, and only one of more than a block of shingles is dealt into several.
5. A search is DivideSkip: over the inverted lists of the query's shingles, the short ones are merged by a
   heap, skipping what cannot reach the required overlap, and the long ones are probed by binary search.

Shingles are compared by 64-bit hashes. The heavy shingles that are put last are a bounded table, which
changes the speed only. Defined cases: null and empty texts, and texts of white space, have no set and no
link; repeated rows are one document; a row without an id gets its text's component.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.state import Bitmap, components, small_batches, written
from weftline.llm.text import U64, mix, releasing, shingle_sets, text_slices

#: Bytes of text worked on at once; shingles of one flush, how often one must occur in it to be reported as heavy, and the most that are kept.
SLICE, FLUSH, HEAVY, MOST_HEAVY = 1 << 19, 1_000_000, 3, 1 << 18
#: Shingles of a block of sets or queries, on average.
BLOCK = 1 << 19


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def least_overlap(n: int, m: int, percent: int = 80) -> int:
    """The least number of shared shingles with which sets of n and m link."""
    return _ceil(percent * (n + m), 100 + percent)


class Lists:
    """Inverted lists over sorted sets of hashes, and T-occurrence searches in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(self.sizes, kind="stable")  # owners by size: those of a list stay in this order
        self.names = order.tolist()
        values = np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in self.names)])
        owner = np.repeat(np.arange(len(order)), self.sizes[order])
        sort = np.argsort(values, kind="stable")
        self.owner = owner[sort]
        values = values[sort]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
        self.values, self.edges = values[first], np.concatenate((first, [len(values)]))
        self.sizes = self.sizes[order]

    def search(self, query: np.ndarray, percent: int = 80) -> list[tuple[int, int]]:
        """(set, shared shingles) of the sets that link with the query, a sorted set of hashes."""
        n = len(query)
        low, high = np.searchsorted(self.sizes, (_ceil(percent * n, 100), 100 * n // percent + 1)).tolist()
        if not n or low == high:
            return []
        at = np.searchsorted(self.values, query)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == query]
        least = least_overlap(n, int(self.sizes[low]), percent)
        if len(at) < least:
            return []
        at = at[np.argsort(self.edges[at + 1] - self.edges[at], kind="stable")].tolist()
        longest = self.edges[at[-1] + 1] - self.edges[at[-1]]
        long = min(least - 1, int(least / (0.01 * log2(max(2, longest)) + 1)))
        entries = [self.owner[self.edges[k] : self.edges[k + 1]] for k in at]
        merged, probed = [e.tolist() for e in entries[: len(at) - long]], entries[len(at) - long :]
        found = [(k, count) for k, count in _merge_skip(merged, least - long) if low <= k < high]
        if not found:
            return []
        names, counts = (np.array(x) for x in zip(*found, strict=True))
        need = -(-percent * (n + self.sizes[names]) // (100 + percent))
        for left, probe in zip(range(long, 0, -1), probed, strict=True):
            if left % 16 == 0:  # what can't reach the overlap any more leaves
                able = counts + left >= need
                names, counts, need = names[able], counts[able], need[able]
                if not len(names):
                    break
            place = np.minimum(probe.searchsorted(names), len(probe) - 1)
            counts = counts + (probe[place] == names)
        return [(self.names[k], count) for k, count in zip(names[counts >= need].tolist(), counts[counts >= need].tolist(), strict=True)]


def _merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """The entries of at least `least` of the sorted lists, with their counts."""
    heap = [(entries[0], k, 0) for k, entries in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            target = top + 1
        else:  # what comes before the least-th list's entry can't be in enough lists
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, k, place in popped:
            entries = lists[k]
            place = bisect_left(entries, target, place)
            if place < len(entries):
                heapq.heappush(heap, (entries[place], k, place))


def _class_of(s: np.ndarray) -> int:
    """A set's class: a hash of its shingles, as a signed 64-bit number."""
    total = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int((total * U64(0x9E3779B97F4A7C15) + np.full(1, len(s), np.uint64)).view(np.int64)[0]) if len(s) else 0


def _first(n: int, percent: int) -> int:
    return min(n, n - _ceil(percent * n, 100) + 1 + n // 12)


def _frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """Rows (heavy, id, n, class): a document's class and size; or, if heavy, a shingle and its count."""
    schema = pa.schema([("heavy", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64())])

    def flush(kept: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(kept), return_counts=True)
        often = counts >= HEAVY
        n = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.nulls(n, pa.int64()), pa.array(counts[often].astype(np.int64)), pa.array(values[often].view(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0
        for whole in batches:
            for batch in text_slices(whole, limit=SLICE):
                sets = shingle_sets(batch.column("text"), width)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), batch.column("doc_id"), pa.array(n), pa.array([_class_of(s) for s in sets], pa.int64())], schema=schema)
                kept += sets
                size += int(n.sum())
                if size >= FLUSH:
                    yield flush(kept)
                    kept, size = [], 0
        if size:
            yield flush(kept)

    return docs.mapInArrow(releasing(run), "heavy boolean, doc_id long, n long, class long")


def _prefixes(docs: DataFrame, heavy, kept: Bitmap | None, width: int, percent: int) -> DataFrame:
    """(key, class, n): the first shingles of every set; only those that the bitmap holds, if there is one."""
    schema = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, weight = heavy.value
        for whole in batches:
            for batch in text_slices(whole, limit=SLICE):
                keys, classes, sizes = [], [], []
                for s in shingle_sets(batch.column("text"), width):
                    if not len(s):
                        continue
                    first, rest = _first(len(s), percent), s
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        known = often[at] == s
                        if known.any():
                            rest = s[~known]
                            if len(rest) < first:
                                late = s[known]
                                rest = np.concatenate((rest, late[np.lexsort((late, weight[at[known]]))]))
                    keys.append(rest[:first])
                    classes.append(_class_of(s))
                    sizes.append(len(s))
                if not keys:
                    continue
                counts = [len(k) for k in keys]
                key, owner, n = np.concatenate(keys), np.repeat(np.array(classes, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts)
                if kept is not None:
                    hit = kept.holds(key)
                    key, owner, n = key[hit], owner[hit], n[hit]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner), pa.array(n)], schema=schema)

    return docs.mapInArrow(releasing(run), "key long, class long, n int")


def _sets(docs: DataFrame, wanted: Bitmap, width: int) -> DataFrame:
    """(class, shingles): the sets of the wanted classes, once for each task that meets them."""
    schema = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for whole in batches:
            for batch in text_slices(whole, limit=SLICE):
                sets = shingle_sets(batch.column("text"), width)
                classes = np.array([_class_of(s) for s in sets], np.int64)
                keep = [k for k in np.flatnonzero(wanted.holds(classes.view(np.uint64))) if len(sets[k]) and int(classes[k]) not in done and not done.add(int(classes[k]))]
                if len(done) > 200_000:
                    done.clear()
                yield pa.RecordBatch.from_arrays([pa.array(classes[keep]), pa.array([sets[k].tobytes() for k in keep], pa.binary())], schema=schema)
        done.clear()

    return docs.mapInArrow(releasing(run), "class long, shingles binary").dropDuplicates(["class"])


def _searched(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """The links (a, b) found in blocks of rows (keys, class, component, part, shingles): the queries, with
    part 0, among the others; for one query and component one link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, others = None, [], []

        def links() -> pa.RecordBatch:
            found = []
            if queries and others:
                lists = Lists([np.frombuffer(data, np.uint64) for *_, data in others])
                for name, component, data in queries:
                    linked = {component}
                    for k, _ in lists.search(np.frombuffer(data, np.uint64), percent):
                        if others[k][1] not in linked:
                            linked.add(others[k][1])
                            found.append((name, others[k][0]))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for block, name, component, part, data in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), *(batch.column(c).to_pylist() for c in ("class", "component", "part", "shingles")), strict=True):
                if block != at:
                    yield links()
                    at, queries, others = block, [], []
                (others if part else queries).append((name, component, data))
        yield links()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(run), "a long, b long")


def _dealt(sides: DataFrame, own: str, other: str, salt: int) -> DataFrame:
    """The rows of one part, each in one block of its own side and in all blocks of the other one."""
    mine = F.pmod(F.xxhash64("class", F.lit(salt)), own).alias(f"{own}_block")
    return sides.withColumn(f"{own}_block", mine).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))


def _against(target: str, queries: DataFrame, others: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between queries and others (target, class, component, n) of one target. Either side of a target is dealt into
    blocks of BLOCK shingles: a side within one block, as nearly all are, is never repeated."""
    sizes = queries.groupBy(target).agg(F.sum("n").alias("ask")).join(others.groupBy(target).agg(F.sum("n").alias("has")), target)
    sizes = sizes.select(target, *(F.ceil(F.col(c) / BLOCK).alias(c) for c in ("ask", "has")))
    asking = _dealt(queries.join(sizes, target), "ask", "has", 1).withColumn("part", F.lit(0))
    asked = _dealt(others.join(sizes, target), "has", "ask", 0).withColumn("part", F.lit(1))
    keys = [target, "ask_block", "has_block"]
    return _searched(asking.unionByName(asked).select(*keys, "class", "component", "part").join(sets, "class"), keys, percent)


def _against_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (hub, other, m, n)."""
    hubs = pairs.groupBy("hub").agg(F.first("m").alias("n")).select("hub", F.col("hub").alias("class"), F.col("hub").alias("component"), "n")
    return _against("hub", hubs, pairs.select("hub", F.col("other").alias("class"), F.col("other").alias("component"), "n"), sets, percent)


def _outside(nodes: DataFrame) -> DataFrame:
    """Of clusters with several components the nodes outside the largest one."""
    parts = nodes.groupBy("cluster", "component").count()
    several = parts.groupBy("cluster").agg(F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return nodes.join(several.select("cluster", F.col("most.component").alias("most")), "cluster").where("component <> most").drop("most")


def _between(crossing: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between different components of a cluster, and of the pairs of clusters that share an early shingle: of a pair, those members
    of the smaller cluster that share enough with the larger one are queries to it, and a cluster answers all its queries at once.
    crossing: _crossing(); nodes: (class, cluster, component, n)."""
    sizes = nodes.groupBy("cluster").agg(F.sum("n").alias("size"))
    early = crossing.where("early").select("key", "cluster").distinct()
    a, b = early.toDF("key", "a"), early.toDF("key", "b")
    pairs = a.join(b, "key").where("a < b").select("a", "b").distinct().join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    swap = F.col("size_a") > F.col("size_b")
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("cluster"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("target"))
    met = crossing.select("key", F.col("cluster").alias("target")).distinct()
    asking = pairs.join(crossing.select("cluster", "class", "key", "n"), "cluster").join(met, ["target", "key"]).groupBy("target", "class", "n").count().where(F.col("count") >= _least("n", percent))
    queries = asking.select("target", "class").join(nodes.select("class", "component", "n"), "class").select("target", "class", "component", "n")
    queries = written(queries.unionByName(_outside(nodes).select(F.col("cluster").alias("target"), "class", "component", "n")))
    others = nodes.select(F.col("cluster").alias("target"), "class", "component", "n").join(queries.select("target").distinct(), "target", "left_semi")
    return _against("target", queries, others, sets, percent)


def _crossing(everything: DataFrame, percent: int) -> DataFrame:
    """The rows (key, class, n, cluster) of shingles that several clusters have, of classes with enough of them. early: a class's
    least shared ones, but for one less than it needs: two classes that link have one of those in common."""
    clusters = everything.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("rows")).where("low < high").select("key", "rows")
    rows = everything.join(clusters, "key")
    own = Window.partitionBy("class")
    rows = rows.withColumn("of", F.count("*").over(own)).where(F.col("of") >= _least("n", percent))
    rows = rows.withColumn("at", F.row_number().over(own.orderBy("rows", "key")))
    return rows.select("key", "class", "n", "cluster", (F.col("at") <= F.col("of") - _least("n", percent) + 1).alias("early"))


def _least(n: str, percent: int):
    """How many of its first shingles a set shares at least with any that it links with."""
    return 1 + F.floor(F.ceil(percent * F.col(n) / 100) / 12)


def _enough(shared: str, n: str, m: str):
    return F.col(shared) >= 1 + F.floor(F.least(n, m) / 12)


def _sized(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _wanted_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    nodes = written(nodes.distinct())
    wanted = Bitmap(nodes, "class", nodes.count())
    sets = written(_sets(docs, wanted, width).join(nodes, "class", "left_semi"))
    wanted.release()
    return sets


def _labelled(rows: DataFrame, label: DataFrame, name: str) -> DataFrame:
    return rows.join(label.toDF("class", name), "class", "left").withColumn(name, F.coalesce(name, "class"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the smallest id that links reach.
    percent: the least similarity; width: words of a shingle."""
    docs = _frame(docs, id_col, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    signatures = written(_signatures(docs, width))
    often = signatures.where("heavy").groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "class").limit(MOST_HEAVY).toArrow()
    values, counts = often.column("class").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(values)
    heavy = spark.sparkContext.broadcast((values[order], counts[order]))
    signatures = signatures.where("not heavy")

    def shared(rows: DataFrame, *more) -> DataFrame:
        return rows.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), *more).where("low < high").drop("low", "high")

    keys = written(shared(_prefixes(docs, heavy, None, width, percent)))
    kept = Bitmap(keys, "key", keys.count())
    rows = written(_prefixes(docs, heavy, kept, width, percent).distinct())
    kept.release()
    heavy.unpersist()
    # a linked class shares m(0.8 n) shingles at least
    able = rows.groupBy("class", "n").count().where(F.col("count") >= _least("n", percent)).select("class")
    rows = written(rows.join(able, "class", "left_semi"))
    rows = written(rows.join(shared(rows, F.count("*").alias("size")), "key"))
    lists = written(rows.join(rows.groupBy("class").agg(F.sum("size").alias("weight")), "class").select("key", "class", "n", "weight"))

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    hubs = lists.groupBy("key", band.alias("band")).agg(F.max(F.struct("weight", "class", "n")).alias("hub"))
    pairs = lists.withColumn("band", band).join(hubs, ["key", "band"]).where("class <> hub.class")
    pairs = pairs.groupBy(F.col("class").alias("other"), "n", F.col("hub.class").alias("hub"), F.col("hub.n").alias("m")).count().where(_enough("count", "n", "m") & _sized("n", "m", percent))
    best = written(pairs.groupBy("other", "n").agg(F.max(F.struct("count", "hub", "m")).alias("best")).select(F.col("best.hub").alias("hub"), F.col("best.m").alias("m"), "other", "n"))
    sets = _wanted_sets(docs, best.select(F.col("hub").alias("class")).union(best.select("other")), width)
    links = written(_against_hubs(best, sets, percent))
    label, cluster = components(links), written(_clusters(best))

    everything = _labelled(lists.select("key", "class", "n"), cluster, "cluster")
    crossing = written(_crossing(everything, percent))
    nodes = written(_labelled(everything.select("class", "n", "cluster").distinct(), label, "component"))
    meeting = crossing.select("cluster").union(_outside(nodes).select("cluster")).distinct()
    nodes = written(nodes.join(meeting, "cluster", "left_semi"))
    if nodes.isEmpty():
        return _named(signatures, label)
    more = _between(crossing, nodes, _wanted_sets(docs, nodes.select("class"), width), percent)
    more = written(more)
    if more.isEmpty():
        return _named(signatures, label)
    # the further links join components: of these, those they reach are found, and followed
    a, b = label.toDF("a", "x"), label.toDF("b", "y")
    joined = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    over = components(joined)
    ends = label.unionByName(over.select("node", F.col("node").alias("component")).join(label, "node", "left_anti"))
    label = ends.join(over.toDF("component", "reached"), "component", "left").select("node", F.coalesce("reached", "component").alias("component"))
    return _named(signatures, label)


def _clusters(best: DataFrame) -> DataFrame:
    """(class, cluster): every class with its hub's hub's hub, as far as there is one. Any division into clusters is
    right, as pairs of different clusters are searched too."""
    step = best.select(F.col("other").alias("from"), F.col("hub").alias("to"))
    out = best.select(F.col("hub").alias("class")).union(best.select("other")).distinct().withColumn("cluster", F.col("class"))
    for _ in range(3):
        out = out.join(step, F.col("cluster") == F.col("from"), "left").select("class", F.coalesce("to", "cluster").alias("cluster"))
    return out


def _named(signatures: DataFrame, label: DataFrame) -> DataFrame:
    """Every document with the smallest id of its component, which is found over classes."""
    filled = signatures.where("n > 0")
    classes = _labelled(filled.groupBy("class").agg(F.min("doc_id").alias("least")), label, "component")
    first = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = filled.join(classes.join(first, "component").select("class", "component_id"), "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(signatures.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
