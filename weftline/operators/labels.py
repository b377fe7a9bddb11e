"""Tokenising text, places of tokens, white-space classes, composite labels, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.lexing import lexed, slices
from weftline.functions.text import clip

def lex(files: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, idx, value, start, stop, line, col): tokens that cover the text, with 0-based offsets and 1-based lines and
    columns. Narrow: a text is lexed where it is read, in linear time; a null text has no tokens."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                row, columns = lexed(batch.column(text))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row)), *columns], names=[id_col, "idx", "value", "start", "stop", "line", "col"])

    return files.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, idx int, value string, start long, stop long, line long, col long")


def white_classes(tokens: DataFrame) -> DataFrame:
    """class: space, newline, quote or none."""
    v = F.col("value")
    return tokens.withColumn("class", F.when(v.startswith("\n"), "newline").when(v.rlike(r"^\s"), "space").when(v == '"', "quote").otherwise("none"))


def indentation(lines: DataFrame, id_col: str) -> DataFrame:
    """lines (id, line, text) with indent, inc and dec: the spaces that a line begins with, and how many more or fewer
    than the last line that isn't blank."""
    rows = lines.withColumn("indent", F.length("text") - F.length(F.ltrim(F.col("text")))).where(F.trim("text") != "")
    change = F.col("indent") - F.coalesce(F.lag("indent").over(Window.partitionBy(id_col).orderBy("line")), F.lit(0))
    return rows.withColumn("inc", F.greatest(change, F.lit(0))).withColumn("dec", F.greatest(-change, F.lit(0)))


def composites(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, first, label): runs of white tokens as one label, the classes joined by +; a quote is a run of its own."""
    names = F.array(*(F.lit(c) for c in ("space", "newline", "quote")))
    # place and class in one number, so that little is shuffled, sorted and collected
    pos = F.col("idx").cast("long") * 4 + F.array_position(names, F.col("class")) - 1
    marked = white_classes(tokens).where(F.col("class") != "none").select(id_col, pos.alias("pos"))
    order = Window.partitionBy(id_col).orderBy("pos")
    place, kind = F.floor(F.col("pos") / 4), F.col("pos") % 4
    before = F.lag("pos").over(order)
    breaks = (place != F.coalesce(F.floor(before / 4), F.lit(-2)) + 1) | (kind == 2) | (before % 4 == 2)
    runs = marked.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(order))
    grouped = runs.groupBy(id_col, "run").agg(F.array_sort(F.collect_list("pos")).alias("parts"))
    first = F.floor(F.col("parts")[0] / 4).cast("int")
    return grouped.select(id_col, first.alias("first"), F.array_join(F.transform("parts", lambda p: F.get(names, (p % 4).cast("int"))), "+").alias("label"))


def noops(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, at): the places between two neighbours without a label, and before the first and behind the last such token."""
    order = Window.partitionBy(id_col).orderBy("idx")
    rows = white_classes(tokens).withColumn("before", F.lag("class").over(order)).withColumn("behind", F.lead("class").over(order))
    plain = rows.where("class = 'none'")
    gaps = plain.where("before = 'none' or before is null").select(id_col, F.col("start").alias("at"))
    return gaps.unionByName(plain.where("behind is null").select(id_col, F.col("stop").alias("at")))


def support(labels: DataFrame, label: str, cutoff: int) -> DataFrame:
    """(label, support, label_id): labels with enough support; the most frequent one is 0."""
    counts = labels.groupBy(label).agg(F.count("*").alias("support")).where(F.col("support") >= cutoff)
    return counts.withColumn("label_id", F.row_number().over(Window.orderBy(F.desc("support"), label)) - 1)


def quote_pairs(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, idx, content): a quote, one token and a quote in a row."""
    order = Window.partitionBy(id_col).orderBy("idx")
    rows = tokens.withColumn("content", F.lead("value", 1).over(order)).withColumn("close", F.lead("value", 2).over(order))
    return rows.where("value = '\"' and close = '\"' and content <> '\"'").select(id_col, "idx", "content")


def neighbours(tokens: DataFrame, id_col: str, left: int = 2, right: int = 2) -> DataFrame:
    """Nearest tokens that aren't white on either side, as columns l1.. and r1.., and the clipped distances of the first left one."""
    kept = white_classes(tokens).where("class not in ('space', 'newline')")
    order = Window.partitionBy(id_col).orderBy("idx")
    for k in range(1, left + 1):
        kept = kept.withColumn(f"l{k}", F.lag("value", k).over(order))
    for k in range(1, right + 1):
        kept = kept.withColumn(f"r{k}", F.lead("value", k).over(order))
    for name in ("start", "line", "col"):
        kept = kept.withColumn(f"diff_{name}", clip(F.abs(F.col(name) - F.lag(name).over(order))))
    return kept


def bag(tokens: DataFrame, id_col: str, classes: list[str]) -> DataFrame:
    return white_classes(tokens).groupBy(id_col).agg(*(F.count_if(F.col("class") == c).alias(f"n_{c}") for c in classes))


def one_hot(tokens: DataFrame, values: list[str], column: str = "value") -> DataFrame:
    for k, v in enumerate(values):
        tokens = tokens.withColumn(f"is_{k}", (F.col(column) == v).cast("int"))
    return tokens


def carried(df: DataFrame, key: str, order: str, value: Column, forward: str, backward: str) -> DataFrame:
    """The nearest value that isn't null, before and behind each row (the row itself included)."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(forward, F.last(value, ignorenulls=True).over(past)).withColumn(backward, F.first(value, ignorenulls=True).over(future))
