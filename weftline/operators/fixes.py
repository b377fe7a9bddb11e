"""Predicted labels back into text, and review lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_labels(tokens: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """tokens with the predicted value where there is one, and the old value. predictions: (keys, predicted, conf). A merge, as a plan takes
    tokens to be as small as the texts they come from and would send them to the driver whole."""
    both = tokens.join(predictions.hint("merge"), keys, "left")
    return both.withColumn("old", F.col("value")).withColumn("value", F.coalesce("predicted", "value")).drop("predicted")


def text_of(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, text): each text from its tokens, in their order."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return tokens.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("text"))


def line_fixes(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id, line, old, new, confidence): the lines with a changed token; confidence: the mean of the changed ones', in percent."""
    changed = F.col("value") != F.col("old")
    def joined(c: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda p: p[c]), "")

    rows = tokens.groupBy(id_col, "line").agg(joined("old").alias("old"), joined("value").alias("new"), F.bround(100 * F.avg(F.when(changed, F.col("conf")))).cast("int").alias("confidence"), F.max(changed).alias("changed"))
    return rows.where("changed").drop("changed")


def comments(fixes: DataFrame, id_col: str) -> DataFrame:
    """One review comment per fixed line."""

    def stripped(c: str):
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    text = F.concat(F.lit("line "), F.col("line"), F.lit(": "), stripped("old"), F.lit(" -> "), stripped("new"))
    return fixes.select(F.col(id_col).alias("file"), F.col("line").cast("int").alias("line"), text.alias("text"), "confidence")


def unbalanced(files: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """The texts whose brackets or quotes don't pair up by number."""
    def n(c: str):
        return F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))

    return files.where((n("(") != n(")")) | (n("[") != n("]")) | (n("{") != n("}")) | (n('"') % 2 == 1)).select(id_col)
