"""Structured Streaming forms of the batch behaviour: candles over tumbling windows, and late copies dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def candles(trades: DataFrame, every: str = "1 minute", late: str | None = "1 hour") -> DataFrame:
    """Open, high, low, close and volume of each ticker and window of (ticker, ts, price, count, trade_id).

    Works on streams and tables. On a stream, a window closes `late` after its end (None: the stream has a watermark already); of trades at one instant the lowest
    trade_id counts as first.
    """
    order = F.struct("ts", "trade_id")
    rows = trades.withWatermark("ts", late) if trades.isStreaming and late else trades
    out = rows.groupBy("ticker", F.window("ts", every).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("count").alias("volume"),
    )
    return out.select("ticker", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume")


def without_copies(trades: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each trade_id once: on a stream among those no more than `late` apart, on a table among all."""
    if trades.isStreaming:
        return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trade_id"])
    return trades.dropDuplicates(["trade_id"])
