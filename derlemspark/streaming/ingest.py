"""File streams into a versioned table, and a watermarked count over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.state import write_upsert


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, overwrite: bool = False) -> StreamingQuery:
    """Every micro-batch of new files is merged by key; a replayed batch leaves the table as it was, as keys decide."""
    return stream.writeStream.foreachBatch(lambda batch, _: write_upsert(batch, path, key, order, overwrite)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time_col: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
