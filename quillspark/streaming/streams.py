"""Streaming forms of the event operators, over any streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(paths: DataFrame, at: str, quiet: str = "250 milliseconds", late: str = "1 minute") -> DataFrame:
    """Paths coalesced until none arrives for ``quiet``: one sorted set a burst and root."""
    rows = paths.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy("root", F.session_window(at, quiet).alias("s")).agg(F.sort_array(F.collect_set("path")).alias("paths")).select("root", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "paths")


def unseen(findings: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first of each key inside the watermark."""
    return findings.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def latest_into(stream: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each key in Parquet versions under ``target``;
    a batch that is run again writes its version again, so it counts once."""

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        every = batch
        if number:
            every = batch.unionByName(spark.read.parquet(f"{target}/batch-{number - 1}"))
        row = F.struct(*[F.col(c) for c in every.columns])
        every.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{target}/batch-{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
