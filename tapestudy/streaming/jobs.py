"""Structured Streaming jobs: live bars and scheduled scans (M1-M2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions.windows import keys
from ..operators.bars import ohlcv, with_clock


def stream_bars(ticks: DataFrame, freq: str = "60 minutes", late: str = "10 minutes", *, symbol="symbol", ts="ts", price="price", size="size", order=None) -> DataFrame:
    """M1: bars of a tick stream: tumbling windows closed by a watermark, with the same aggregates as the batch bars. Ticks later than ``late`` behind
    the newest are dropped; in append mode a bar appears once its window is closed."""
    plain = isinstance(ticks.schema[ts].dataType, TimestampNTZType)
    # watermarks need a zoned timestamp: wall-clock times are read in the session zone (UTC has no gaps) and written back
    marked = (ticks.withColumn(ts, F.col(ts).cast("timestamp")) if plain else ticks).withWatermark(ts, late)
    out = marked.groupBy(*keys(symbol), F.window(ts, freq).alias("_w")).agg(*ohlcv(order if order is not None else ts, price, size))
    start = F.col("_w.start").cast("timestamp_ntz") if plain else F.col("_w.start")
    return with_clock(out.withColumn("ts", start).drop("_w"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into parquet; the checkpoint makes a restart continue where it stopped."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_scan(bars: DataFrame, history: str, scan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, lookback_days: int | None = None, *, symbol="symbol", d="d"):
    """M2: run a scan on every new slice of a bar stream together with the sessions before it.

    ``history`` is a parquet folder with ``batch=base`` holding the bars known so far; each micro-batch is added to it as its own ``batch``
    folder, and the scan's rows for the new bars (by symbol and day) go to ``sink`` under the same batch number. Both writes replace the folder of a
    repeated batch, so a retry after a failure leaves no duplicates. The whole history is read back unless ``lookback_days``
    says how many calendar days the scan looks at.
    """

    def one_batch(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        new.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
        fresh = spark.read.parquet(f"{history}/batch={batch_id}")
        first = fresh.agg(F.min(d).alias("first")).first()["first"]
        if first is None:
            return
        earlier = F.col("batch") != str(batch_id)
        known = spark.read.option("basePath", history).schema(fresh.schema.add("batch", "string")).parquet(history)
        known = known.filter(earlier if lookback_days is None else earlier & (F.col(d) >= F.date_sub(F.lit(first), lookback_days))).drop("batch")
        new_keys = fresh.select(*keys(symbol), d).distinct()
        scan(known.unionByName(fresh)).join(new_keys, [*keys(symbol), d], "left_semi").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return bars.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
