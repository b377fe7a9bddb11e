"""Span tables and trees: cover, overlap and exact joins, ancestors.

Spans that are lexed from texts are many times as many as the texts, which a plan takes for their size: their joins are merges, as what was foreseen to be
small would be sent to the driver whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return a.select(key, F.col("start").alias("a_start"), F.col("stop").alias("a_stop")), b.select(key, F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))


def cover_join(a: DataFrame, b: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Spans of a with the spans of b that cover them. b is dealt into cells of width offsets, so the join has an equality
    beside the key, and one long text is no single group."""
    a, b = _sides(a, b, key)
    b = b.withColumn("cell", F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor(F.col("b_stop") / width))))
    return a.withColumn("cell", F.floor(F.col("a_start") / width)).join(b.hint("merge"), [key, "cell"]).where("b_start <= a_start and a_stop <= b_stop").drop("cell")


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Spans of a and b that share a point; an empty span shares the points from its start on: it meets a span that
    begins there or holds it inside, and an equal empty one."""
    a, b = _sides(a, b, key)

    def dealt(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor(F.col(f"{side}_stop") / width))))

    meets = (F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop"))
    empty = ((F.col("a_start") == F.col("a_stop")) | (F.col("b_start") == F.col("b_stop"))) & (F.col("a_start") == F.col("b_start"))
    both = dealt(a, "a").join(dealt(b, "b").hint("merge"), [key, "cell"]).where(meets | empty)
    # of the cells that two spans share, the first counts
    return both.where(F.col("cell") == F.floor(F.greatest("a_start", "b_start") / width)).drop("cell")


def exact_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key, "start", "stop").distinct().hint("merge"), [key, "start", "stop"], "left_semi")


def conflicts(spans: DataFrame, key: str) -> DataFrame:
    """Pairs of overlapping spans of one layer; a valid layer has none."""
    return overlap_join(spans, spans, key).where("a_start < b_start or a_start = b_start and a_stop < b_stop")


def bad_spans(spans: DataFrame) -> DataFrame:
    return spans.where("start is null or stop is null or start < 0 or stop < start")


def parents(nodes: DataFrame, depth: int, node: str = "node", parent: str = "parent") -> DataFrame:
    """node with its ancestors parent_1 .. parent_depth; null beyond the root."""
    step = nodes.select(F.col(node).alias("from"), F.col(parent).alias("to"))
    out = nodes.select(F.col(node), F.col(parent).alias("parent_1"))
    for k in range(2, depth + 1):
        out = out.join(step, F.col(f"parent_{k - 1}") == F.col("from"), "left").drop("from").withColumnRenamed("to", f"parent_{k}")
    return out


def ancestors(nodes: DataFrame, depth: int, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, up): all ancestors up to depth steps, the node itself at 0."""
    wide = parents(nodes, depth, node, parent)
    chain = F.array(F.col(node), *(F.col(f"parent_{k}") for k in range(1, depth + 1)))
    return wide.select(F.col(node).alias("node"), F.posexplode(chain).alias("up", "ancestor")).where("ancestor is not null")


def common_ancestor(pairs: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(a, b, ancestor): the lowest common ancestor of each pair; null without one."""
    up = ancestors(nodes, depth)
    left = pairs.join(up.toDF("a", "up_a", "ancestor"), "a")
    shared = left.join(up.toDF("b", "up_b", "ancestor"), ["b", "ancestor"])
    best = shared.groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("up_a") + F.col("up_b"), F.col("ancestor"))).alias("ancestor"))
    return pairs.join(best, ["a", "b"], "left")


def kept_spans(spans: DataFrame, key: str) -> DataFrame:
    """Of each key's spans, in the order of their starts, longer ones first, those that don't overlap the last one kept. A key, one text, is one
    fold over its spans."""
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("far")))).alias("all"))
    none = F.struct(F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("kept"), F.lit(-1).cast("long").alias("end"))

    def step(state, span):
        start, stop = span["start"].cast("long"), (-span["far"]).cast("long")
        taken = F.struct(F.concat(state["kept"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("kept"), stop.alias("end"))
        return F.when(start >= state["end"], taken).otherwise(state)

    return lists.select(key, F.explode(F.aggregate("all", none, step, lambda s: s["kept"])).alias("s")).select(key, "s.start", "s.stop")
