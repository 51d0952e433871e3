"""Extension: signals that arrive as a stream. The engine itself is batch; this keeps counts and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeweave.operators.graph import remove


def windowed_activity(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(window, event_type, n, value) of a stream events(ts, event_type, value), late ones dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def upsert_stream(signals: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("place_id", "source")) -> StreamingQuery:
    """Keeps the latest row of each key of a stream in a table, versioned by batch, so a repeated batch changes nothing.

    A row that arrives late doesn't replace a newer one; of equally new ones the later batch counts. Rows without a time
    count as oldest. The version before the last is kept for readers, older ones go.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_batch", F.lit(n))
        if n > 0:
            rows = spark.read.parquet(f"{path}/v={n - 1}").withColumn("_batch", F.lit(n - 1)).unionByName(rows)
        order = F.struct(F.coalesce("observed_at", F.lit("0001-01-01").cast("timestamp")), "_batch")
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        newest.write.mode("overwrite").parquet(f"{path}/v={n}")
        if n > 1:
            remove(spark, f"{path}/v={n - 2}")

    return signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
