"""Incremental runs: new files of a log are folded into a table of the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.operators.ranking import last_wins


def fold_log(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], order: list[str]) -> None:
    """Read what is new in ``source`` (JSON lines) and append its latest rows to ``target``, batch by batch.

    Each batch is reduced to the last row of each key before it is written; the
    checkpoint remembers what was read, so a restart repeats nothing.  The
    batch's number is part of the row, so readers take the latest of all.
    """

    def write(batch: DataFrame, number: int) -> None:
        last_wins(batch, keys, order).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(lambda b, n: write(b.drop("batch"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key over all batches."""
    return last_wins(spark.read.parquet(target), keys, [*order, "batch"]).drop("batch")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their value by type and window of event time; works on streams and tables."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")
