"""Event streams: windowed counts with late data, first sightings, retraining and reviews in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import rules as rule_operators
from weftline.operators.metrics import change_ratio


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def window_counts(events: DataFrame, size: str, late: str | None = None, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, events, total): events per window; on a stream, late is how long a window waits, and later rows are left out."""
    if late:
        events = events.withWatermark(ts, late)
    counts = events.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("w.start").alias("start"), kind, "events", "total")


def first_sightings(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once: on a stream within the watermark's state, which forgets what is older, on a table once in all."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def review(changes: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]):
    """Runs batch on every micro-batch of changes; a restart goes on behind the last finished one."""
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def review_with_rules(changes: DataFrame, rules: DataFrame, id_cols: list[str], features: list[str]) -> DataFrame:
    """Changes, a stream or a table of samples, with the prediction of the rules, which are a table read when the stream starts. A
    stream-static plan without state: the rules are predicates of the stream's own narrow plan."""
    return rule_operators.apply_rules(changes, rules, id_cols, features)


def needs_training(base: DataFrame, head: DataFrame, key: str, ratio: float) -> DataFrame:
    """(key, lines, changed) of those whose share of changed lines is over the ratio."""
    return change_ratio(base, head, key).where(F.col("changed") > ratio * F.greatest("lines", F.lit(1)))


def retrain_on_push(pushes: DataFrame, checkpoint: str, known: Callable[[], DataFrame], train: Callable[[DataFrame, DataFrame], None], key: str = "repository", ratio: float = 0.2):
    """For every micro-batch of pushed lines (key, line): train(the keys that changed by more than the ratio against known()'s lines, the
    lines of the batch). Nothing is trained when no key did."""
    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            due = needs_training(known(), rows, key, ratio).select(key)
            if not due.isEmpty():
                train(due, rows.join(due, key, "left_semi"))
        finally:
            rows.unpersist()

    return review(pushes, checkpoint, batch)


def counted(df: DataFrame, name: str, **counters) -> DataFrame:
    """df, of which each run or micro-batch reports the counters, aggregates by name, to the session's listeners."""
    return df.observe(name, *(c.alias(n) for n, c in counters.items()))


def followed(spark: SparkSession, take: Callable[[str, dict], None]):
    """A listener, already added, that gives take() each observed name and its counters, of streams; remove it by
    spark.streams.removeListener()."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            for name, row in (event.progress.observedMetrics or {}).items():
                take(name, row.asDict())

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
