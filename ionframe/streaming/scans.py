"""File streams: scans searched as they arrive, and windowed counts with late data.

The batch plan has no streams; these are extensions for instruments that write while they measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through a batch plan; a batch that runs again after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per tumbling window and key; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def write_windows(windows: DataFrame, out: str, checkpoint: str, closed_only: bool = True) -> StreamingQuery:
    """Windows of a stream as Parquet under `out`, over all that is there now; a later call with the same checkpoint goes on.

    closed_only: each window once, when the watermark has passed its end, and late rows of closed windows are left out.
    Otherwise all windows so far, late rows included: every batch replaces the table.
    """
    if closed_only:
        return windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return windows.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
