"""Deliveries read as they arrive: each record is parsed once, failures are counted by event-time window. The batch operators do the work; a stream only feeds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulara.operators import rowparse

SCHEMA = "raw_no bigint, contest string, file_path string, loaded_at timestamp, raw_line string"


def read_deliveries(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def parsed_once(deliveries: DataFrame, schema: rowparse.RowSchema, late: str = "30 days") -> DataFrame:
    """Parsed records, each raw_no once within the watermark: state is kept for `late` and no longer."""
    once = deliveries.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["raw_no"])
    return rowparse.parse_rows(once, "raw_line", schema)


def failures_by_window(parsed: DataFrame, size: str = "7 days") -> DataFrame:
    """(window_start, contest, reason, n); a window is final once the watermark has passed it."""
    failed = parsed.where("parsed.status = 'failed'")
    grouped = failed.groupBy(F.window("loaded_at", size).alias("w"), "contest", F.col("parsed.reason").alias("reason")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "contest", "reason", "n")


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is final to a parquet table until nothing new is there; started again with the same checkpoint it goes on from there."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
