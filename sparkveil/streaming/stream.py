"""The same operations on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.detectors import Registry
from ..operators.detect import rewrite_texts
from ..operators.tokens import issue


def redacted_stream(spark: SparkSession, path: str, schema, text_col: str = "text", registry: Registry | None = None, files_per_batch: int = 16) -> DataFrame:
    """Parquet files as they arrive, redacted; rows are independent, so there is no state."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rewrite_texts(stream, text_col, registry)


def token_sink(stream: DataFrame, path: str, checkpoint: str, text_col: str = "text", ttl_seconds: int = 86_400, salt: str | None = None):
    """Append each batch's tokens to the token table; a repeated batch overwrites its own folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        issue(batch, text_col, F.current_timestamp(), ttl_seconds, salt).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and kind, with late rows up to a watermark."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), kind_col).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind_col, "n")
