"""Incremental maintenance as a stream: an extension, for tables that grow by files.

New rows are deduplicated by key within a watermark, appended once, and the counts that hang on them are derived again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.plans.storage import exists


def new_rows(spark: SparkSession, path: str, schema: str, key: str, event_time: str, late: str = "1 day") -> DataFrame:
    source = spark.readStream.schema(schema).parquet(path)
    timed = source.withColumn("__t", F.col(event_time).cast("timestamp")).withWatermark("__t", late)
    return timed.dropDuplicatesWithinWatermark([key]).drop("__t")


def append_once(target: str, key: str, after: Callable[[DataFrame], None] | None = None, event_time: str | None = None, late: str = "1 day") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch goes to a folder of its own number, so a batch that is run again overwrites itself; keys
    that earlier batches hold are left out.  With ``event_time``, a column of the rows, only what those hold from ``late``
    before the batch's first event on is read: nothing older can come again, as the watermark that drops repeats is as long."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        if exists(spark, target):
            before = spark.read.parquet(target).where(F.col("batch") < number)
            if event_time is not None:
                first = batch.agg((F.min(F.col(event_time).cast("timestamp")) - F.expr(f"INTERVAL {late}")).alias("t")).first().t
                if first is not None:
                    before = before.where(F.col(event_time) >= F.lit(first).cast(batch.schema[event_time].dataType))
            fresh = batch.join(before.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if after is not None:
            after(spark.read.parquet(target))

    return write


def maintain(rows: DataFrame, target: str, checkpoint: str, key: str, after: Callable[[DataFrame], None] | None = None, event_time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Runs to the end of what is there and stops."""
    write = append_once(target, key, after, event_time, late)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, event_time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    timed = rows.withColumn("__t", F.col(event_time).cast("timestamp")).withWatermark("__t", late)
    counted = timed.groupBy(F.window("__t", width), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")
