"""Bars as a stream: late ticks within the watermark still count, and a bar is given out when its window has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", levels: bool = False) -> DataFrame:
    """Bars (or, with `levels`, price ladders) of a stream of classified trades with ts, event_id, contract, price, level, qty and side."""
    t = ticks.withWatermark("ts", delay).groupBy("contract", *(["level"] if levels else []), F.window("ts", window).alias("w"))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0))
    at = F.struct("ts", "event_id")
    out = t.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"), (side(1) - side(-1)).alias("delta"), side(1).alias("buy"), side(-1).alias("sell"),
    )
    return out.select("contract", *(["level"] if levels else []), F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume", "delta", "buy", "sell")


def write_bars(bars: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append finished bars to a Parquet table; with available_now the query ends when it has read what there is."""
    w = bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
