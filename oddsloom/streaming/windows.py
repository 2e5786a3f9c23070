"""Windowed aggregates and state over trades and quotes; each works on batches and on streams alike.

The batch result is the definition: a stream, once it has seen the same rows, has the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late a row may come.
LATENESS = "1 day"


def watermarked(df: DataFrame, at: str = "observed_at", lateness: str = LATENESS) -> DataFrame:
    return df.withWatermark(at, lateness) if df.isStreaming else df


def _prices() -> list:
    return [F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean")]


def tumbling(df: DataFrame, width: str, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Count, low, high and mean of prices in adjoining windows."""
    return watermarked(df).groupBy(F.window("observed_at", width), *keys).agg(*_prices())


def sliding(df: DataFrame, width: str, step: str, keys: Sequence[str] = ("event_type",)) -> DataFrame:
    """Counts in overlapping windows."""
    return watermarked(df).groupBy(F.window("observed_at", width, step), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, gap: str, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Runs of observations with less than ``gap`` between neighbours."""
    return watermarked(df).groupBy(*keys, F.session_window("observed_at", gap).alias("session")).agg(F.count("*").alias("n"))


def deduplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key; on a stream, within the watermark."""
    return watermarked(df).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def quotes_of_trades(trades: DataFrame, quotes: DataFrame, within: str = "2 hours") -> DataFrame:
    """Trades with the quotes of their market at most ``within`` before them: an interval join, on streams bounded by it."""
    t = watermarked(trades, "traded_at").alias("t")
    q = watermarked(quotes, "observed_at").alias("q")
    near = (F.col("t.market_id") == F.col("q.market_id")) & (F.col("q.observed_at") <= F.col("t.traded_at")) & (F.col("q.observed_at") >= F.col("t.traded_at") - F.expr(f"INTERVAL {within}"))
    return t.join(q, near).select("t.market_id", "t.trade_id", "t.traded_at", "q.observed_at", "q.price")
