"""What multi-stage operators keep between stages: written tables, bounded bitmaps, components.

Written tables go to the folder in spark.checkpoint.dir, which all executors share, so a lost executor
costs a stage at most; they go when the application ends. Only fixed-size summaries reach the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of a bitmap that is broadcast: 2**20 to 2**28 bits, 32 MB.
MIN_BITS, MAX_BITS = 20, 28
#: Bytes of an Arrow batch.
BATCH = 4 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only on one machine, as in tests, a folder of our own where none is set."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="weftline-")
    return "file://" + _own[app]


def hash_limit(share: float) -> int:
    """The 64-bit hashes up to which the share, 0 to 1, of all lie: a sample of so many rows stays one however many rows there are."""
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes: a batch of whole texts is held twice by a worker and twice by its executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, each finished action's shuffle files go at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, *parts: str, kept: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage. parts: df's last columns, by which it is laid out; kept: gets its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path, compression=codec)
    if kept is not None:
        kept.append(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


class Bitmap:
    """A broadcast set of slots, the low bits of 64-bit hashes. It holds all that was put in and, as slots
    are shared, some more: a filter that loses nothing, behind which an exact join or count follows."""

    def __init__(self, hashes: DataFrame, column: str, count: int):
        spark = hashes.sparkSession
        self.bits = int(min(max(int(count * 16).bit_length(), MIN_BITS), MAX_BITS))
        slot = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1)) + 1
        rows = (
            hashes.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("place"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap")).toArrow()
        )
        table = np.zeros(1 << (self.bits - 3), np.uint8)
        for bucket, bitmap in zip(rows.column("bucket").to_pylist(), rows.column("bitmap"), strict=True):
            table[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap.as_buffer(), np.uint8)
        self.table = spark.sparkContext.broadcast(table)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "table": self.table}

    def release(self) -> None:
        """Frees the executors' copies; a task that runs once more would fetch its own."""
        self.table.unpersist()

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes.astype(np.uint64, copy=False) & np.uint64((1 << self.bits) - 1)
        return (self.table.value[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node that a chain of
    links reaches. Each turn every node goes over to its smallest neighbour, which at least halves the
    nodes of every component that isn't done; the turns' steps are then followed."""
    edges = written(links.select("a", "b").where("a <> b"))
    label: DataFrame | None = None
    while label is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = written(both.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("new")).select("old", F.least("old", "new").alias("new")))
        a, b = step.toDF("a", "x"), step.toDF("b", "y")
        edges = written(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if label is None:
            label = step.toDF("node", "component")
        else:
            label = written(label.join(step, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")))
    return label
