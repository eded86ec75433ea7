"""Ticks to bars and bars to coarser bars (G1), last value per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col, minute_of_day
from ..functions.windows import keys


def bar_start(ts, freq: str):
    """Start of the tumbling bucket of ``ts``; keeps the timestamp type."""
    return F.window(as_col(ts), freq)["start"]


def ohlcv(order, price="price", size="size"):
    """OHLCV aggregates of ticks. ``order`` is one primitive column (a long or a timestamp), so the
    aggregation keeps fixed-width buffers and stays a hash aggregate with map-side partials."""
    order, price = as_col(order), as_col(price)
    return [
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(as_col(size).cast("double")).alias("volume"),
    ]


def daily_bars(ticks: DataFrame, *, symbol="symbol", ts="ts", price="price", size="size", order=None) -> DataFrame:
    """One bar per symbol and day. A symbol holding a third of all ticks costs nothing extra: each
    task first reduces its ticks to at most one partial bar per symbol and day."""
    d = F.to_date(as_col(ts)).alias("d")
    return ticks.groupBy(*keys(symbol), d).agg(*ohlcv(order if order is not None else ts, price, size))


def intraday_bars(ticks: DataFrame, freq: str = "60 minutes", *, symbol="symbol", ts="ts", price="price",
                  size="size", order=None) -> DataFrame:
    """One bar per symbol and bucket, with its day and minute of day."""
    start = bar_start(ts, freq).alias("ts")
    bars = ticks.groupBy(*keys(symbol), start).agg(*ohlcv(order if order is not None else ts, price, size))
    return with_clock(bars)


def with_clock(bars: DataFrame, ts="ts") -> DataFrame:
    return bars.withColumns({"d": F.to_date(ts), "minute_of_day": minute_of_day(ts)})


def resample(bars: DataFrame, freq: str | None = None, *, symbol="symbol", ts="ts") -> DataFrame:
    """G1: coarser bars from bars: first open, max high, min low, last close, summed volume.

    ``freq`` is a bucket length such as '4 hours'; without it the result is daily.
    """
    when = F.to_date(ts).alias("d") if freq is None else bar_start(ts, freq).alias("ts")
    out = bars.groupBy(*keys(symbol), when).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"))
    return out if freq is None else with_clock(out)


def dedupe_series(df: DataFrame, *, value="value", ts="ts", symbol="symbol", order=None) -> DataFrame:
    """The last value of each symbol and day."""
    return df.groupBy(*keys(symbol), F.to_date(ts).alias("d")).agg(
        F.max_by(as_col(value), as_col(order if order is not None else ts)).alias(value))
