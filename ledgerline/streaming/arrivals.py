"""Streams of corrections and events: best correction per invoice, windowed counts with late data.

State is bounded by the invoices (best correction) or by the watermark (windows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.learning import keep_best


def stream_parquet(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def best_corrections(corrections: DataFrame) -> DataFrame:
    """The batch rule as a running aggregate; write it in update or complete mode."""
    return keep_best(corrections)


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and value per window and kind; later rows than ``late`` are left out and closed windows leave the state."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", kind, "n", "value")


def run_once(df: DataFrame, sink: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Process what is there into an in-memory table and stop."""
    query = df.writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
