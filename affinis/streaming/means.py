"""Users' means kept up to date by a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.columns import shown
from affinis.functions.workers import shared_folder


def running_means(events: DataFrame) -> DataFrame:
    """(user_id, n, mean) of a stream or table of (user_id, value): sums per user are its state."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def windowed_means(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, user_id, n, mean) by windows of event time; a window's state goes once the watermark has passed it."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "user_id", "n", "mean")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running means after the events table has passed through a stream, all that is there at once.

    Each batch's whole state goes to a table of its own in the shared checkpoint folder; the last one is the result.
    """
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a stream reads folders; the pattern names one table of the folder
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    folder = f"{shared_folder(spark)}/means-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = running_means(stream).writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}-state").outputMode("complete").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    last = spark.read.parquet(folder)
    newest = last.agg(F.max("batch").alias("batch"))
    return last.join(F.broadcast(newest), "batch").select("user_id", "n", shown(F.col("mean")).alias("mean"))
