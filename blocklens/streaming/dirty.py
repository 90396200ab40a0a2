"""Dirty bitmaps kept up from a stream of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def granules(writes: DataFrame, granularity: int, late: str = "10 minutes") -> DataFrame:
    """First time each granule is touched; repeats within the watermark are dropped by state."""
    touched = writes.withWatermark("ts", late).select("bitmap", F.expr(f"offset div {granularity}").alias("granule"), "ts")
    return touched.dropDuplicatesWithinWatermark(["bitmap", "granule"])


def windowed_writes(writes: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Writes and bytes per window and bitmap; late rows beyond the watermark are left out."""
    return writes.withWatermark("ts", late).groupBy(F.window("ts", size), "bitmap").agg(F.count(F.lit(1)).alias("writes"), F.sum("length").alias("bytes"))


def keep_bitmap(writes: DataFrame, granularity: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append newly touched granules to a table; a batch that is run again adds the same rows.

    Each batch writes a folder of its own, named by its number and overwritten on a rerun.
    """
    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("bitmap", F.expr(f"offset div {granularity}").alias("granule")).distinct()
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return writes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
