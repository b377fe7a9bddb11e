"""Scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import rewrite
from weftline.operators import alignment, metrics, vocabulary
from weftline.plans.registry import query
from weftline.sources.tables import table

_GUESS = "SELECT doc_id, d.source, quality, CASE WHEN l.doc_id % 11 = 0 THEN -1 WHEN n_chars > 200 THEN 1 ELSE 0 END AS guess, toxic FROM labels l JOIN documents d USING (doc_id)"


def guesses(spark, d):
    """(doc_id, source, quality, guess): a guess from the length, refused for some."""
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    guess = F.when(F.col("doc_id") % 11 == 0, -1).when(F.col("n_chars") > 200, 1).otherwise(0)
    return both.select("doc_id", "source", "quality", guess.alias("guess"), "toxic")


def _rounded(df, *names, digits=9):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


_DIV = "coalesce({0} / nullif({1}, 0), 0.0)"


@query(f"""WITH g AS ({_GUESS}), s AS (SELECT count(*) FILTER (quality = 1 AND guess = 1) AS tp, count(*) FILTER (quality <> 1 AND guess = 1) AS fp, count(*) FILTER (quality = 1 AND guess <> 1) AS fn, count(*) AS n FROM g),
 r AS (SELECT *, {_DIV.format('tp', '(tp + fp)')} AS p, {_DIV.format('tp', '(tp + fn)')} AS r FROM s) SELECT round((n - fp - fn) / n, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round({_DIV.format('2 * p * r', '(p + r)')}, 9) AS f1 FROM r""")
def scores_detection(spark, d):
    found = metrics.scores(guesses(spark, d), F.col("quality") == 1, F.col("guess") == 1)
    return _rounded(found, *found.columns)


@query(f"""WITH g AS (SELECT * FROM ({_GUESS}) WHERE toxic = 1), s AS (SELECT count(*) FILTER (quality = 1 AND guess = 1) AS tp, count(*) FILTER (quality <> 1 AND guess = 1) AS fp, count(*) FILTER (quality = 1 AND guess <> 1) AS fn, count(*) AS n FROM g),
 r AS (SELECT *, {_DIV.format('tp', '(tp + fp)')} AS p, {_DIV.format('tp', '(tp + fn)')} AS r FROM s) SELECT round({_DIV.format('(n - fp - fn)', 'n')}, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall, round({_DIV.format('2 * p * r', '(p + r)')}, 9) AS f1 FROM r""")
def scores_on_typoed(spark, d):
    """The same scores on the rows of one kind only."""
    found = metrics.scores(guesses(spark, d).where("toxic = 1"), F.col("quality") == 1, F.col("guess") == 1)
    return _rounded(found, *found.columns)


_REPORT = f"""WITH g AS ({_GUESS}), t AS (SELECT quality AS class, count(*) FILTER (guess >= 0) AS support, count(*) AS full_support, count(*) FILTER (guess = quality) AS hits FROM g GROUP BY quality),
 p AS (SELECT guess AS class, count(*) AS guesses FROM g WHERE guess >= 0 GROUP BY guess),
 j AS (SELECT coalesce(t.class, p.class) AS class, coalesce(support, 0) AS support, coalesce(full_support, 0) AS full_support, coalesce(hits, 0) AS hits, coalesce(guesses, 0) AS guesses FROM t FULL JOIN p ON t.class = p.class),
 r AS (SELECT *, {_DIV.format('hits', 'guesses')} AS precision, {_DIV.format('hits', 'support')} AS recall, {_DIV.format('hits', 'full_support')} AS full_recall FROM j),
 report AS (SELECT class, precision, recall, {_DIV.format('2 * precision * recall', '(precision + recall)')} AS f1, support, full_recall, {_DIV.format('2 * precision * full_recall', '(precision + full_recall)')} AS full_f1, full_support FROM r)"""


@query(f"{_REPORT} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support, round(full_recall, 9) AS full_recall, round(full_f1, 9) AS full_f1, full_support FROM report")
def class_report(spark, d):
    return _rounded(metrics.class_report(guesses(spark, d), "quality", "guess"), "precision", "recall", "f1", "full_recall", "full_f1")


@query(f"{_REPORT} SELECT 'macro' AS average, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM report UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9) FROM report")
def report_averages(spark, d):
    return _rounded(metrics.averages(metrics.class_report(guesses(spark, d), "quality", "guess")), "precision", "recall", "f1")


@query(f"SELECT quality AS class, count(*) FILTER (guess = -1) AS as_refused, count(*) FILTER (guess = 0) AS as_0, count(*) FILTER (guess = 1) AS as_1 FROM ({_GUESS}) GROUP BY quality")
def confusion_matrix(spark, d):
    return metrics.confusion(guesses(spark, d), "quality", "guess", [0, 1])


@query(f"SELECT round(avg(CASE WHEN guess >= 0 THEN 1.0 ELSE 0.0 END), 9) AS ppcr FROM ({_GUESS})")
def ppcr(spark, d):
    return _rounded(metrics.predicted_rate(guesses(spark, d), "guess"), "ppcr")


@query(f"SELECT source, count(*) AS errors FROM ({_GUESS}) WHERE guess >= 0 AND guess <> quality GROUP BY source ORDER BY errors DESC, source LIMIT 10")
def errors_per_file_topn(spark, d):
    return metrics.errors_by_group(guesses(spark, d), "source", (F.col("guess") >= 0) & (F.col("guess") != F.col("quality")), 10)


_NATIONS = "SELECT n_name AS name, avg(c_acctbal) AS balance, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = {0} GROUP BY n_name"


def by_nation(spark, d, part):
    rows = table(spark, d, "customer").where(F.col("c_custkey") % 2 == part).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("name")).agg(F.avg("c_acctbal").alias("balance"), F.count("*").alias("customers"))


@query(f"""WITH r AS ({_NATIONS.format(0)}) SELECT name, round(balance, 6) AS balance, round(customers, 6) AS customers FROM (SELECT name, balance, CAST(customers AS DOUBLE) AS customers FROM r
 UNION ALL SELECT 'average', avg(balance), avg(customers) FROM r UNION ALL SELECT 'weighted average', sum(balance * customers) / sum(customers), avg(customers) FROM r)""")
def report_summary(spark, d):
    return _rounded(metrics.with_averages(by_nation(spark, d, 0), "name", ["balance"], "customers"), "balance", "customers", digits=6)


@query(f"WITH a AS ({_NATIONS.format(0)}), b AS ({_NATIONS.format(1)}) SELECT a.name, round(b.balance - a.balance, 6) AS balance, b.customers - a.customers AS customers FROM a LEFT JOIN b USING (name)")
def report_compare(spark, d):
    return _rounded(metrics.compare(by_nation(spark, d, 0), by_nation(spark, d, 1), "name", ["balance", "customers"]), "balance", digits=6)


@query("SELECT o_orderpriority, round(coalesce(sum(o_totalprice * (o_custkey % 3)) / nullif(sum(o_custkey % 3), 0), 1), 6) AS mean FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'none', 1.0")
def weighted_average(spark, d):
    orders = table(spark, d, "orders").withColumn("w", F.col("o_custkey") % 3)
    mean = metrics.weighted_average("o_totalprice", "w").alias("mean")
    none = orders.where("w = 0 and w = 1").agg(F.lit("none").alias("o_orderpriority"), mean)
    return _rounded(orders.groupBy("o_orderpriority").agg(mean).unionByName(none), "mean", digits=6)


@query("SELECT l_orderkey, round(1 - product(1 - l_discount) + 1e-12, 9) AS any FROM lineitem GROUP BY l_orderkey")
def joint_probability(spark, d):
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_discount")).alias("c"))
    return grouped.select("l_orderkey", F.round(metrics.joint(F.col("c")) + 1e-12, 9).alias("any"))


@query("""WITH t AS (SELECT doc_id, text, text[length(text) // 2 + 1:] AS rest FROM documents), n AS (SELECT doc_id, length(text) - length(replace(text, ', ', ',')) AS n, length(rest) - length(replace(rest, ', ', ',')) AS later FROM t)
SELECT doc_id, 0 AS misdetected, CAST(later AS INTEGER) AS undetected, 0 AS wrong_fix, CAST(n - later AS INTEGER) AS right_fix FROM n""")
def aligned_metrics(spark, d):
    """A text, restyled, and a prediction that restores its first half."""
    half = F.floor(F.length("a") / 2).cast("int")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    first, rest = F.substring(F.col("a"), F.lit(1), half), F.substring(F.col("a"), half + 1, F.length("a"))
    docs = docs.withColumn("b", rewrite("a", "comma_tight")).withColumn("c", F.concat(first, rewrite(rest, "comma_tight")))
    return alignment.aligned_metrics(docs, "a", "b", "c").drop("a", "b", "c")


_DRAWS = 200


@query(f"""WITH p AS (SELECT c_custkey, c_custkey % 10 + 1 AS freq, md5(CAST(c_custkey AS VARCHAR))[1:3] AS bucket FROM customer),
 r AS (SELECT c_custkey, freq, sum(freq) OVER (ORDER BY bucket, c_custkey) AS high FROM p), t AS (SELECT sum(freq) AS total FROM p),
 d AS (SELECT k AS draw, CAST(floor(((k + 1) * 1103515245 + 12345) % 2147483648 / 2147483648.0 * total) AS BIGINT) AS pos FROM range({_DRAWS}) n(k), t)
SELECT draw, c_custkey FROM d JOIN r ON high - freq <= pos AND pos < high""")
def weighted_sample(spark, d):
    """Customers drawn in proportion to a weight."""
    customers = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 10 + 1).alias("freq"))
    return vocabulary.weighted_sample(customers, _DRAWS, "freq", "c_custkey").select("draw", "c_custkey")


@query("SELECT event_id, CASE WHEN CAST('0x' || md5(CAST(user_id AS VARCHAR))[1:8] AS BIGINT) % 100 < 90 THEN 'train' ELSE 'test' END AS part FROM events")
def hash_split(spark, d):
    """Events dealt to train and test by their user."""
    return vocabulary.hash_split(table(spark, d, "events"), "user_id").select("event_id", "part")


@query("""WITH a AS (SELECT avg(c_acctbal + 1000) AS mean FROM customer) SELECT c_custkey FROM customer, a
WHERE CAST('0x' || md5(CAST(c_custkey AS VARCHAR))[1:8] AS BIGINT) / 4294967296.0 < 0.3 * (c_acctbal + 1000) / mean""")
def picked_subset(spark, d):
    """Customers picked with a chance that grows with their balance."""
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") + 1000).alias("w"))
    return vocabulary.pick_subset(rows, 0.3, "c_custkey", "w").select("c_custkey")
