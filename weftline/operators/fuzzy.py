"""Fuzzy dictionary lookup by symmetric deletion, candidates and their ranking."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from weftline.functions.text import deletes, letter_mask, log_ratio, phrase_words, with_distance
from weftline.operators.spelling import near_words


def tasks(spark: SparkSession) -> int:
    """How many tasks work that grows out of small tables is dealt to: as many as the session shuffles to, and as it has cores at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def build_dictionary(words: DataFrame, threshold: int = 1) -> DataFrame:
    """(term, count) of rows (term, count): the counts of repeated words add up; words below the threshold stay out, and
    negative counts are 0."""
    counts = words.groupBy("term").agg(F.sum(F.greatest(F.col("count"), F.lit(0))).cast("long").alias("count"))
    return counts.where((F.col("count") >= threshold) & F.col("term").isNotNull())


def add_words(state: DataFrame | None, words: DataFrame, threshold: int = 1) -> DataFrame:
    """(term, count, known, enters): a dictionary and its staging table as one, after more words. Counts of words (term, count) add up to those of the
    state; a word is staged, not known, until its added counts reach the threshold, and then enters: only the words that enter have to
    be added to a stored index. Null words take no part, and negative counts are 0; a state is what this gave before, or None at first."""
    more = words.where("term is not null").groupBy("term").agg(F.sum(F.greatest(F.col("count"), F.lit(0))).cast("long").alias("more"))
    if state is None:
        state = more.where("false").select("term", F.col("more").alias("count"), F.lit(False).alias("known"))
    both = state.select("term", "count", "known").join(more, "term", "full")
    total = F.coalesce("count", F.lit(0)) + F.coalesce("more", F.lit(0))
    was = F.coalesce("known", F.lit(False))
    return both.select("term", total.cast("long").alias("count"), (was | (total >= threshold)).alias("known"), (~was & (total >= threshold)).alias("enters"))


def deletes_index(dictionary: DataFrame, depth: int = 1, prefix: int | None = None, *more: str) -> DataFrame:
    """(delete, term, count): every word under its deletes, or those of its first prefix letters; a word of depth letters
    at most also under the empty one. more: further columns to keep."""
    start = F.col("term") if prefix is None else F.substring("term", 1, prefix)
    found = deletes(start, depth)
    found = F.when(F.length("term") <= depth, F.array_union(found, F.array(F.lit("")))).otherwise(found)
    # explode_outer, as what explode infers, that the list isn't empty, would be pushed down to every occurrence of the words
    return dictionary.where("term is not null").select(F.explode_outer(found).alias("delete"), "term", "count", *more)


def fuzzy_join(queries: DataFrame, dictionary: DataFrame, depth: int = 1, prefix: int | None = None) -> DataFrame:
    """(query, term, count, distance): the words within the restricted Damerau-Levenshtein distance depth.
    Both sides meet in their deletes, by an equi-join; then the distance is taken. With prefix, more than depth, only the deletes of the first prefix letters are
    made, which finds the same words: an index row is as short and a long word has as few of them as a short one, but more words
    meet. Before the distance, pairs go whose lengths differ by more than depth or whose sets of letters differ by more than twice depth, as one edit
    changes at most two letters of the sets. At depth 2 words meet in arrays (spelling.py), if counts are whole numbers."""
    if prefix is not None and prefix <= depth:
        raise ValueError("the prefix must be longer than the distance")
    if depth == 2 and isinstance(dictionary.schema["count"].dataType, IntegralType):
        return near_words(queries, dictionary, tasks(queries.sparkSession), prefix)
    part = F.col("query") if prefix is None else F.substring("query", 1, prefix)
    # a dictionary is small until its deletes are made and met, which adaptive plans can't foresee: the number of tasks is stated
    n = tasks(queries.sparkSession)
    asked = queries.select("query").repartition(n, "query").distinct().select("query", letter_mask("query").alias("q_mask"), deletes(part, depth).alias("all"))
    asked = asked.select("query", "q_mask", F.explode_outer("all").alias("delete"))
    index = deletes_index(dictionary.repartition(n, "term").select("term", "count", letter_mask("term").alias("t_mask")), depth, prefix, "t_mask")
    letters = F.bit_count(F.col("q_mask").bitwiseXOR(F.col("t_mask")))
    alike = (F.abs(F.length("query") - F.length("term")) <= depth) & (letters <= 2 * depth)
    # a word meets itself in all its deletes, which were half of all pairs: only in the one that is its own letters
    alike &= (F.col("query") != F.col("term")) | (asked["delete"] == part)
    pairs = asked.repartition(n, "delete").hint("merge").join(index.repartition(n, "delete"), (asked["delete"] == index["delete"]) & alike)
    # most pairs that meet are too far apart, and go before those that met more than once are shuffled
    return with_distance(pairs, "query", "term", depth, letters=letters).select("query", "term", "count", "distance").distinct()


def best_terms(found: DataFrame, verbosity: int) -> DataFrame:
    """0: the best word of each query; 1: all of the least distance; 2: all."""
    if verbosity == 2:
        return found
    order = Window.partitionBy("query").orderBy("distance", F.desc("count"), "term")
    if verbosity == 0:
        return found.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")
    return found.withColumn("least", F.min("distance").over(Window.partitionBy("query"))).where("distance = least").drop("least")


def most_per_distance(found: DataFrame, n: int) -> DataFrame:
    """At most n words for each query and distance, the most frequent ones."""
    order = Window.partitionBy("query", "distance").orderBy(F.desc("count"), "term")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n)


def compound(phrases: DataFrame, dictionary: DataFrame, phrase: str = "phrase", depth: int = 1) -> DataFrame:
    """(phrase, corrected): each phrase word by word. A word is kept if known, else replaced by the nearer of the best word within
    depth and of its best cut in two words; a word that makes a nearer word together with the one before it is merged into it.
    All lookups, of words, of neighbours run together and of the parts of unknown words, are one distributed join; the walk along
    a phrase is one fold over its words."""
    words = phrases.select(F.col(phrase).alias("phrase")).distinct().select("phrase", F.posexplode(phrase_words("phrase")).alias("at", "query"))
    order = Window.partitionBy("phrase").orderBy("at")
    words = words.withColumn("before", F.lag("query").over(order))
    runs = words.where("before is not null").select(F.concat("before", "query").alias("query"))
    known = dictionary.select("term", "count")
    unknown = words.select("query").distinct().join(known, F.col("query") == F.col("term"), "left_anti").where(F.length("query") > 1)
    cuts = unknown.select(F.col("query").alias("word"), F.explode(F.sequence(F.lit(1), F.length("query") - 1)).alias("k"))
    cuts = cuts.select("word", "k", F.substring(F.col("word"), F.lit(1), F.col("k")).alias("a"), F.substring(F.col("word"), F.col("k") + 1, F.length("word")).alias("b"))
    asked = words.select("query").union(runs).union(cuts.select("a")).union(cuts.select("b")).distinct()
    best = best_terms(fuzzy_join(asked, known, depth), 0).select("query", F.struct("term", "distance", "count").alias("best"))
    a, b = best.toDF("a", "best_a"), best.toDF("b", "best_b")
    parts = cuts.join(a, "a").join(b, "b")
    cost = F.col("best_a.distance") + F.col("best_b.distance") + 1
    cut = F.struct(cost.alias("distance"), (-F.least("best_a.count", "best_b.count")).alias("rare"), "k", F.concat_ws(" ", "best_a.term", "best_b.term").alias("term"))
    parts = parts.groupBy("word").agg(F.min(cut).alias("cut"))
    rows = words.join(best.withColumnRenamed("best", "own"), "query", "left").join(parts.withColumnRenamed("word", "query"), "query", "left")
    rows = rows.withColumn("run", F.concat("before", "query")).join(best.toDF("run", "both"), "run", "left")
    single = F.when(F.col("own.distance") == 0, F.struct(F.col("query").alias("term"), F.lit(0).alias("distance")))
    nearer = F.col("cut").isNotNull() & (F.col("own").isNull() | (F.col("cut.distance") < F.col("own.distance")))
    single = single.when(nearer, F.struct(F.col("cut.term").alias("term"), F.col("cut.distance").alias("distance")))
    single = single.when(F.col("own").isNotNull(), F.struct(F.col("own.term").alias("term"), F.col("own.distance").alias("distance")))
    single = single.otherwise(F.struct(F.col("query").alias("term"), F.lit(depth + 1).alias("distance")))
    rows = rows.select("phrase", "at", single.alias("one"), F.struct(F.col("both.term").alias("term"), F.col("both.distance").alias("distance")).alias("both"))
    lists = rows.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "one", "both"))).alias("words"))
    start = F.lit(None).cast("struct<done:array<string>,last:struct<term:string,distance:int>,merged:boolean>")

    def step(state: Column, word: Column) -> Column:
        merges = state.isNotNull() & ~state["merged"] & word["both"]["term"].isNotNull() & (word["both"]["distance"] + 1 < state["last"]["distance"] + word["one"]["distance"])
        one = F.struct(word["one"]["term"].alias("term"), word["one"]["distance"].cast("int").alias("distance"))
        pair = F.struct(word["both"]["term"].alias("term"), (word["both"]["distance"] + 1).cast("int").alias("distance"))
        done = F.when(state.isNull(), F.array().cast("array<string>")).when(merges, state["done"]).otherwise(F.concat(state["done"], F.array(state["last"]["term"])))
        return F.struct(done.alias("done"), F.when(merges, pair).otherwise(one).alias("last"), merges.alias("merged"))

    text = F.aggregate("words", start, step, lambda s: F.array_join(F.concat(s["done"], F.array(s["last"]["term"])), " "))
    found = lists.select("phrase", text.alias("corrected"))
    return phrases.select(F.col(phrase).alias("phrase")).distinct().join(found, "phrase", "left").select("phrase", F.coalesce("corrected", F.lit("")).alias("corrected"))


#: Queries of one pass over the rows, and rows of one product of matrices.
PASS, CHUNK = 2048, 512


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k rows of least cosine distance, by brute force of a stated query set against all rows.
    Queries come to the driver in passes of PASS vectors; each is a narrow scan of the rows that keeps k of each query in a task.
    Vectors that are null or hold nulls take no part; a zero vector is at distance 1 from all; ties go to the smaller id."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & F.col("vec_id").isNotNull()
    rows = rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    spark, schema = rows.sparkSession, "query_id long, vec_id long, distance double"
    found = spark.createDataFrame([], schema)
    asked = queries.where(usable).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).toLocalIterator(prefetchPartitions=True)

    while block := list(itertools.islice(asked, PASS)):
        by_size: dict[int, list] = {}
        for row in block:
            by_size.setdefault(len(row[1]), []).append(row)
        shared = spark.sparkContext.broadcast({n: (np.array([r[0] for r in some]), np.array([r[1] for r in some]).reshape(len(some), n)) for n, some in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[np.ndarray]] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    batch = whole.slice(at, CHUNK)
                    ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
                    sizes = np.diff(lists.offsets.to_numpy())
                    for n in set(sizes.tolist()) & shared.value.keys():
                        mine = sizes == n
                        names, q = shared.value[n]
                        x = lists.filter(pa.array(mine)).flatten().to_numpy().reshape(-1, n)
                        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                        distance = np.round(1 - np.divide(q @ x.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)
                        distance[names[:, None] == ids[mine][None, :]] = np.inf
                        old = best.get(n, [np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)])
                        both = np.hstack((old[0], distance)), np.hstack((old[1], np.broadcast_to(ids[mine], distance.shape)))
                        order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
                        best[n] = [np.take_along_axis(c, order, 1) for c in both]
            for n, (distance, ids) in best.items():
                keep = np.isfinite(distance)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shared.value[n][0], keep.sum(1))), pa.array(ids[keep]), pa.array(distance[keep])], names=["query_id", "vec_id", "distance"])

        found = found.union(rows.mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_features(found: DataFrame, frequencies: DataFrame) -> DataFrame:
    """found (query, term, distance) with frequencies of both and their log ratio; unknown words count 0."""
    f = frequencies.select("token", "freq")
    out = found.join(f.toDF("query", "query_freq"), "query", "left").join(f.toDF("term", "term_freq"), "term", "left").fillna(0, ["query_freq", "term_freq"])
    return out.withColumn("log_ratio", log_ratio("query_freq", "term_freq")).withColumn("same_length", F.length("query") == F.length("term"))


def rank_candidates(df: DataFrame, n: int, id_col: str = "id", return_all: bool = True) -> DataFrame:
    """The n best candidates of each id; where the best one is the token itself, only it, with probability 1, or
    nothing unless return_all. df: (id, token, candidate, proba)."""
    order = Window.partitionBy(id_col).orderBy(F.desc("proba"), "candidate")
    ranked = df.withColumn("rank", F.row_number().over(order)).withColumn("best", F.first("candidate").over(order))
    kept = ranked.where((F.col("best") != F.col("token")) & (F.col("rank") <= n))
    if return_all:
        kept = kept.unionByName(ranked.where((F.col("best") == F.col("token")) & (F.col("rank") == 1)).withColumn("proba", F.lit(1.0)))
    return kept.drop("best")


def take_confident(df: DataFrame, threshold: float, id_col: str = "id") -> DataFrame:
    """Of each id's ranked candidates those down to the first one under the threshold, or to the token itself, which is kept."""
    before = Window.partitionBy(id_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("proba") < threshold) | (F.col("candidate") == F.col("token"))).over(before), F.lit(False))
    return df.where(F.col("proba").isNotNull()).withColumn("ended", ended).where(~F.col("ended") & (F.col("proba") >= threshold)).drop("ended")


def normalised(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.withColumn("share", F.try_divide("proba", F.sum("proba").over(Window.partitionBy(id_col))))


def combinations(parts: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The n likeliest ways to take one candidate for each place: (id, text, proba). parts: (id, place, candidate, proba); places are
    folded one after another, keeping the n best each time, which loses none of the n best of all."""
    lists = parts.groupBy(id_col, "place").agg(F.array_sort(F.collect_list(F.struct((-F.col("proba")).alias("p"), F.col("candidate").alias("c")))).alias("choices"))
    rows = lists.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "choices"))), lambda s: s["choices"]).alias("lists"))
    none = F.array(F.struct(F.lit(-1.0).alias("p"), F.lit("").alias("c")))

    def join(done: Column, more: Column) -> Column:
        pairs = F.flatten(F.transform(done, lambda a: F.transform(more, lambda b: F.struct((-(a["p"] * b["p"])).alias("p"), F.trim(F.concat_ws(" ", a["c"], b["c"])).alias("c")))))
        return F.slice(F.array_sort(pairs), 1, n)

    best = rows.select(id_col, F.explode(F.aggregate("lists", none, join)).alias("b"))
    return best.select(id_col, F.col("b.c").alias("text"), (-F.col("b.p")).alias("proba"))
