import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """Two symbols of random daily bars with a few flat bars, as (Spark frame, pandas frame)."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    parts = []
    for sym in ("A", "B"):
        n = 120
        close = 100 + rng.normal(0, 2, n).cumsum()
        open_ = np.where(rng.random(n) < 0.1, close, close + rng.normal(0, 1.5, n))
        pdf = pd.DataFrame({"symbol": sym, "d": pd.bdate_range("2024-01-01", periods=n).date, "open": open_, "close": close})
        pdf["high"] = pdf[["open", "close"]].max(axis=1) + rng.random(n)
        pdf["low"] = pdf[["open", "close"]].min(axis=1) - rng.random(n)
        pdf["volume"] = rng.integers(1, 1000, n).astype(float)
        parts.append(pdf)
    pdf = pd.concat(parts, ignore_index=True)[["symbol", "d", "open", "high", "low", "close", "volume"]]
    return spark.createDataFrame(pdf, "symbol string, d date, open double, high double, low double, close double, volume double"), pdf


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
