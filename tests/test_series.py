import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapestudy.functions import columns as K
from tapestudy.operators import series as S
from tapestudy.operators import stats as A


def column(df, name, sym="A"):
    return [r[0] for r in df.filter(F.col("symbol") == sym).orderBy("d").select(name).collect()]


def same(got, want, tol=1e-9):
    got = np.array([np.nan if x is None else x for x in got], dtype=float)
    assert np.allclose(got, np.asarray(want, dtype=float), rtol=tol, atol=tol, equal_nan=True)


def test_rolling_statistics_match_pandas(toy):
    df, pdf = toy
    c = pdf[pdf.symbol == "A"].close.reset_index(drop=True)
    v = pdf[pdf.symbol == "A"].volume.reset_index(drop=True)
    out = S.rolling_stat(S.rolling_stat(df, "close", 20), "close", 10, "std", 5)
    same(column(out, "mean20"), c.rolling(20).mean())
    same(column(out, "std10"), c.rolling(10, min_periods=5).std())
    same(column(S.zscore(df, "close", 20, 10), "z20"), (c - c.rolling(20, min_periods=10).mean()) / c.rolling(20, min_periods=10).std(), 1e-7)
    same(column(S.rolling_quantile(df, "close", 20, 0.8), "q80_20"), c.rolling(20).quantile(0.8))
    same(column(S.rolling_pct_rank(df, "volume", 30, 10), "pct30"), v.rolling(30, min_periods=10).rank(pct=True) * 100)
    same(column(S.rolling_corr(df, "close", "volume", 20), "corr20"), c.rolling(20).corr(v), 1e-7)


def test_streak_matches_group_counts(toy):
    df, pdf = toy
    c = pdf[pdf.symbol == "B"].close.reset_index(drop=True)
    var = c.pct_change()
    up = (var > 0).astype(int)
    runs = up.groupby(up.ne(up.shift()).cumsum()).cumcount() + 1
    out = S.streak(S.returns(df))
    same(column(out, "consec_up", "B"), up.groupby(up.ne(up.shift()).cumsum()).cumsum())
    same(column(out, "streak", "B"), runs * (up * 2 - 1))


def test_forward_columns_end_in_nulls(toy):
    df, _ = toy
    out = S.forward_closes(df, 3)
    assert column(out, "close_j3")[-3:] == [None, None, None]
    assert column(out, "close_j1")[:-1] == column(df, "close")[1:]


def test_constant_series_has_null_z_and_correlation(spark):
    df = spark.createDataFrame([("A", i, 5.0, float(i)) for i in range(10)], "symbol string, i int, x double, y double").withColumn("d", F.date_add(F.lit("2024-01-01"), F.col("i")))
    out = S.rolling_corr(S.zscore(df, "x", 5), "x", "y", 5)
    assert set(column(out, "z5")) == {None} and set(column(out, "corr5")) == {None}


def test_skewness_is_the_corrected_one(spark, toy):
    df, pdf = toy
    got = {r.symbol: r.s for r in df.groupBy("symbol").agg(K.sample_skewness("volume").alias("s")).collect()}
    for sym, part in pdf.groupby("symbol"):
        assert abs(got[sym] - part.volume.skew()) < 1e-9


def test_leads_are_taken_before_filters(toy):
    df, pdf = toy
    r = S.returns(df)
    got = {x.symbol: x.mean_next for x in A.conditional_next(r, F.col("var_pct") < -1).collect()}
    for sym, part in pdf.groupby("symbol"):
        c = part.close.reset_index(drop=True)
        want = (c.shift(-1) / c - 1)[c.pct_change() * 100 < -1].mean() * 100
        assert abs(got[sym] - want) < 1e-9


def test_changing_the_future_does_not_change_past_columns(toy):
    df, _ = toy
    cut = "2024-04-01"
    changed = df.withColumn("close", F.when(F.col("d") > cut, F.col("close") * 3).otherwise(F.col("close")))
    pick = lambda x: S.drawdown(S.realized_vol(S.momentum(S.lags(x))), window=60, min_periods=10).filter(F.col("d") <= cut).orderBy("symbol", "d").collect()
    assert pick(df) == pick(changed)


def test_buckets_and_text(spark):
    df = spark.createDataFrame([("Décision  de taux, 10Y", 15.0), ("CPI", 100.0), (None, None)], "t string, v double")
    got = df.select(K.slug("t"), K.bucket("v", (0, 15, 20)), K.close_to("v", F.lit(15.0000001)), K.truth(K.contains_any("t", ["cpi"]))).collect()
    assert [tuple(r) for r in got] == [("decision_de_taux_10y", "15-20", True, False), ("cpi", None, False, True), (None, None, None, False)]
    assert pd.isna(None)
