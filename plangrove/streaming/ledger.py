"""Streaming forms of the append-only ledgers (an extension: the batch queries do not need them).

A ledger folder is a file stream.  New rows are validated, keyed rows deduplicated within a watermark, and the latest row of each key is merged
into a table batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import latest_per_key

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def valid(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds) & F.col("user_id").isNotNull())


def unseen(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows whose id has not been seen within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def hourly(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts and means by hour and kind; late rows within the watermark count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def run_available(stream: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Appends what is there now, exactly once, and stops."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, checkpoint: str, path: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keeps a table with the last row of each key: a batch's rows and the table's are compacted into the next generation.

    A generation is the whole table, so batches should be large; of earlier ones only the last stays, for a batch that is repeated.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_per_key(batch, keys, order)
        if number:
            new = latest_per_key(spark.read.parquet(f"{path}/generation={number - 1}").unionByName(new), keys, order)
        # a repeated batch writes the same generation again
        new.write.mode("overwrite").parquet(f"{path}/generation={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
