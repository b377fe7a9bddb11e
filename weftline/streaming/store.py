"""What streams keep: a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, or, on one machine only, where temporary files go."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return f"{path}/weftline-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="weftline-")


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what several jobs of an operator read isn't made anew by each, and a lost executor costs no more
    than what it was at work on. A job, which runs at once."""
    path = folder(df.sparkSession) + "/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last of each key's updates."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return updates.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at", order)


def run_to_end(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Runs a stream until nothing is left to read; every micro-batch's rows are written with its number as _batch. Gives all that was written."""
    spark = stream.sparkSession

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    empty = spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0))
    empty.write.parquet(f"{path}/rows/none")
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{path}/rows/*")
