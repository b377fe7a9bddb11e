"""Classification scores, reports and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(df: DataFrame, truth: Column, prediction: Column) -> DataFrame:
    """accuracy, precision, recall and f1 of two boolean columns; 0 where a denominator is."""
    tp, fp, fn = F.count_if(truth & prediction), F.count_if(~truth & prediction), F.count_if(truth & ~prediction)
    sums = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count("*").alias("n"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    accuracy = _ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n"))
    return sums.select(accuracy.alias("accuracy"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def class_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Per class precision, recall and f1 among the predicted rows, support, and the same on all rows (full_). A negative prediction is a refusal."""
    t, p = F.col(truth), F.col(prediction)
    by_truth = df.groupBy(t.alias("class")).agg(F.count_if(p >= 0).alias("support"), F.count("*").alias("full_support"), F.count_if(p == t).alias("hits"))
    by_guess = df.where(p >= 0).groupBy(p.alias("class")).agg(F.count("*").alias("guesses"))
    rows = by_truth.join(by_guess, "class", "full").fillna(0)
    precision, recall, full = (_ratio(F.col("hits"), F.col(c)) for c in ("guesses", "support", "full_support"))
    return rows.select(
        "class", precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"), "support",
        full.alias("full_recall"), _ratio(2 * precision * full, precision + full).alias("full_f1"), "full_support",
    )


def averages(report: DataFrame) -> DataFrame:
    """The macro and weighted averages of a class report."""
    columns = ("precision", "recall", "f1")
    macro = report.agg(F.lit("macro").alias("average"), *(F.avg(c).alias(c) for c in columns))
    return macro.unionByName(report.agg(F.lit("weighted").alias("average"), *(_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in columns)))


def predicted_rate(df: DataFrame, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(prediction) >= 0, 1.0).otherwise(0.0)).alias("ppcr"))


def confusion(df: DataFrame, truth: str, prediction: str, classes: list[int]) -> DataFrame:
    """One row per true class, one column per prediction, refusals (-1) first. The classes are given, so no job looks for them."""
    return df.groupBy(F.col(truth).alias("class")).agg(*(F.count_if(F.col(prediction) == c).alias(f"as_{'refused' if c < 0 else c}") for c in [-1, *classes]))


def errors_by_group(df: DataFrame, group: str, wrong: Column, n: int) -> DataFrame:
    return df.where(wrong).groupBy(group).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), group).limit(n)


def weighted_average(value: str, weight: str) -> Column:
    """Sum of value * weight over the sum of weights; 1 if that is 0."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(1.0))


def with_averages(report: DataFrame, name: str, columns: list[str], weight: str) -> DataFrame:
    """The report with rows average and weighted average."""
    plain = report.agg(F.lit("average").alias(name), *(F.avg(c).alias(c) for c in columns), F.avg(weight).alias(weight))
    weighted = report.agg(F.lit("weighted average").alias(name), *(weighted_average(c, weight).alias(c) for c in columns), F.avg(weight).alias(weight))
    return report.select(name, *columns, F.col(weight).cast("double").alias(weight)).unionByName(plain).unionByName(weighted)


def compare(base: DataFrame, new: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """new minus base for every row of base."""
    right = new.select(name, *(F.col(c).alias(f"new_{c}") for c in columns))
    return base.join(right, name, "left").select(name, *((F.col(f"new_{c}") - F.col(c)).alias(c) for c in columns))


def precision_curve(by_rule: DataFrame) -> DataFrame:
    """(rule_id, conf, precision, rate): for each cut of the rules by confidence. by_rule: (rule_id, conf, right, total), one row a
    rule; their number is small and bounded, so one ordered window over them is."""
    order = Window.orderBy(F.desc("conf"), "rule_id").rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    right, total = F.sum("right").over(order), F.sum("total").over(order)
    return by_rule.select("rule_id", "conf", F.coalesce(F.try_divide(right, total), F.lit(1.0)).alias("precision"), F.try_divide(total, F.sum("total").over(all_rows)).alias("rate"))


def joint(confidences: Column) -> Column:
    """1 - the product of 1 - c over an array."""
    return 1 - F.aggregate(confidences, F.lit(1.0), lambda s, c: s * (1 - c))


def change_ratio(base: DataFrame, head: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, lines, changed): the lines of head, and how many of them, counted with repeats, base lacks."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key, line).agg(F.count("*").alias(name))

    both = counted(head, "n").join(counted(base, "m"), [key, line], "left")
    return both.groupBy(key).agg(F.sum("n").alias("lines"), F.sum(F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))).alias("changed"))
