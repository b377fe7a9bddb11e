"""Streams, run to their end over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.rules import SCHEMA
from weftline.plans.registry import query
from weftline.sources.tables import table
from weftline.streaming import review, store

_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    return review.window_counts(table(spark, d, "events"), "6 hours")


def events(spark, d):
    return spark.readStream.schema(_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_sightings(spark, d):
    """A stream's first row of each key, while the watermark remembers it: the events' whole month."""
    seen = review.first_sightings(events(spark, d), ["user_id", "event_type"], late="60 days").select("user_id", "event_type")
    return store.run_to_end(seen, store.folder(spark), "append").drop("_batch")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_review_batch(spark, d):
    """The events as a file stream through windowed counts, whose updates are written batch by batch, until nothing is left to read."""
    counts = review.window_counts(events(spark, d), "1 day", late="40 days")
    return store.latest(store.run_to_end(counts, store.folder(spark)), ["start", "event_type"], "_batch")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value <= 10 THEN 'low' END AS prediction, CASE WHEN value > 50 THEN 1 WHEN value <= 10 THEN 0 END AS winner FROM events")
def stream_rules(spark, d):
    """Events as a stream, reviewed by rules, which are a table."""
    rules = spark.createDataFrame([(0, [("value", False, 10.0)], "low", 0.9, 1), (1, [("value", True, 50.0)], "high", 0.95, 1)], SCHEMA)
    found = review.review_with_rules(events(spark, d), rules, ["event_id"], ["value"])
    return store.run_to_end(found, store.folder(spark), "append").drop("_batch")


@query("""WITH h AS (SELECT user_id, event_type || ':' || CAST(event_id % 5 AS VARCHAR) AS line, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL), b AS (SELECT user_id, event_type || ':' || CAST(event_id % 5 AS VARCHAR) AS line, count(*) AS m FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
 c AS (SELECT h.user_id, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(greatest(n - coalesce(m, 0), 0)) AS BIGINT) AS changed FROM h LEFT JOIN b ON h.user_id = b.user_id AND h.line = b.line GROUP BY h.user_id) SELECT user_id, lines, changed FROM c WHERE changed > 0.2 * greatest(lines, 1)""")
def retrained_keys(spark, d):
    """The keys that a stream of pushed lines finds to have changed by over a fifth against the known lines."""
    line = F.concat_ws(":", "event_type", (F.col("event_id") % 5).cast("string")).alias("line")
    known = table(spark, d, "events").where("event_id % 2 = 0").select("user_id", line)
    pushed = events(spark, d).where("event_id % 2 = 1").select("user_id", line)
    path = store.folder(spark)

    def train(due, rows):
        found = review.needs_training(known, rows, "user_id", 0.2).join(due, "user_id", "left_semi")
        found.write.mode("append").parquet(f"{path}/due")

    review.retrain_on_push(pushed, f"{path}/state", lambda: known, train, "user_id").awaitTermination()
    return spark.read.schema("user_id long, lines long, changed long").parquet(f"{path}/due")
