"""Complete results by default, files by header, live scans, folds by session."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestudy.operators import backtest as T
from tapestudy.operators import filters as P
from tapestudy.operators import models as M
from tapestudy.operators import rules as R
from tapestudy.operators import scans as N
from tapestudy.operators import sessions as G
from tapestudy.operators import stats as A
from tapestudy.sources import readers
from tapestudy.sources.shared import shared_dir
from tapestudy.streaming import jobs


def test_columns_by_header_name(spark, tmp_path):
    (tmp_path / "BRK.B_daily.csv").write_text("time;close;open;high;low;volume\n2024-01-02;4;1;5;0,5;10\n")
    (tmp_path / "SPX_30min.csv").write_text("﻿Date,Open,High,Low,Close\n2024-01-02 10:00:00,1.5,2,1,1.75\n")
    (tmp_path / "A+B C.csv").write_text("Volume\tLow\tHigh\tOpen\tClose\tTime\tEMA\n7\t1\t4\t2\t3\t2024-01-02\t9\n")
    got = {r.symbol: (r.freq_min, r.open, r.high, r.low, r.close, r.volume) for r in readers.read_bars(spark, str(tmp_path)).collect()}
    assert got == {"BRK.B": (1440, 1.0, 5.0, 0.5, 4.0, 10.0), "SPX": (30, 1.5, 2.0, 1.0, 1.75, None), "A+B C": (1440, 2.0, 4.0, 1.0, 3.0, 7.0)}
    extra = {r.symbol: r.extras for r in readers.read_bars(spark, str(tmp_path), columns=(*readers.BAR_COLUMNS, "EMA")).collect()}
    assert extra["A+B C"] == {"ema": 9.0} and extra["SPX"] == {"ema": None}
    (tmp_path / "BAD.csv").write_text("time;open;high;low\n2024-01-02;1;1;1\n")
    with pytest.raises(Exception, match="no column close in .*BAD.csv"):
        readers.read_bars(spark, str(tmp_path)).collect()


def test_every_assignment_is_returned(spark, toy):
    rows = N.target_moves(toy[0]).withColumns({c: F.pmod(F.hash("d", F.lit(c)), F.lit(3)).cast("string") for c in "abce"})
    out = N.logic_tree_scan(rows, {c: c for c in "abce"}, ("or", "a", ("or", "b", "c")), labels=("0", "1", "2"), min_n=1)
    assert out.groupBy("symbol").count().filter("count = 81").count() == 2
    assert N.logic_tree_scan(rows, {"a": "a", "b": "b"}, ("or", "a", "b"), labels=("0", "1", "2"), min_n=1, top=2).count() == 4


def test_defaults_cut_nothing(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(i), -6.0, 0.1 * i) for i in range(12)], "symbol string, d date, var_pct double, next_var double")
    assert A.neutral_next(df).count() == 12 and A.neutral_next(df, top=5).count() == 5


def test_all_combinations_of_three_and_four(spark):
    r = np.random.default_rng(4)
    days = pd.bdate_range("2023-01-02", periods=200).date
    names = ["a", "b", "c", "e", "f"]
    values = {n: r.normal(size=200) for n in names}
    feats = spark.createDataFrame([(n, d, float(x)) for n in names for d, x in zip(days, values[n])], "feature string, d date, value double")
    y = r.random(200) < 0.5
    t = spark.createDataFrame([(d, bool(b)) for d, b in zip(days, y)], "d date, hit boolean")
    s = R.materialize(R.rule_sessions(t, "hit"), "sessions")
    lits = R.best_threshold_per_feature(feats, s, min_is=5)
    bits, masks = R.materialize(R.literal_bits(feats, s, lits), "bits"), R.session_masks(s)
    got = {x.rule_id: (x.n_is, x.n_oos) for x in R.combo_k_rules(None, bits, masks, 4, 3, 1, None).collect()}
    on = {x.feature: values[x.feature] >= x.threshold if x.direction == "above" else values[x.feature] <= x.threshold for x in lits.collect()}
    want = {}
    for k in (3, 4):
        for combo in itertools.combinations(sorted(on), k):
            held = np.logical_and.reduce([on[c] for c in combo])
            if held[:140].sum() >= 3 and held[140:].sum() >= 1:
                want[" AND ".join(combo)] = (held[:140].sum(), held[140:].sum())
    assert got == want
    pool = spark.createDataFrame([("a",), ("b",)], "feature string")
    found = R.search_rules(feats, s, 3, 3, 1, 0.0, None, pool=pool, dates=True).collect()
    assert {f for x in found for f in x.features} <= {"a", "b"} and sorted(x["rank"] for x in found) == list(range(1, len(found) + 1))
    assert all(len(x.oos_dates) == x.n_oos for x in found)
    order = sorted(found, key=lambda x: x["rank"])
    assert [(-x.is_robust, -x.n_windows_valid, -x.precision_oos) for x in order] == sorted((-x.is_robust, -x.n_windows_valid, -x.precision_oos) for x in order)


def test_sessions_are_dates(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), s, True) for i in range(100) for s in "AB"]
    out = R.rule_sessions(spark.createDataFrame(rows, "d date, symbol string, y boolean"), "y").collect()
    assert len(out) == 200 and {(r.n_sessions, r.oos_sessions, r.window_sessions) for r in out} == {(100, 30, 11)} and max(r.session_no for r in out) == 100


def test_masks_hide_everything_unfinished(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, i), 1.0, 2.0, 0.5, 1.5, 100.0, 7.0) for i in (1, 2)], "symbol string, d date, open double, high double, low double, close double, volume double, ema double")
    last = P.ex_ante_mask_daily(df, "2024-01-02").orderBy(F.desc("d")).first()
    assert (last.symbol, last.open, last.full_candle) == ("A", 1.0, False) and (last.high, last.low, last.close, last.volume, last.ema) == (None,) * 5
    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 10), 1.0, 2.0, 9.0)], "symbol string, ts timestamp_ntz, open double, close double, volume double")
    row = P.ex_ante_mask_intraday(bars, "2024-01-02 10:30:00", 60).first()
    assert (row.open, row.close, row.volume) == (1.0, None, None)


def test_live_drift_signals(spark):
    days = list(pd.bdate_range("2024-01-01", periods=30).date)
    spans = [1.0] * 19 + [0.1] * 5 + [1.0] * 6
    data = [("A", d, 100.0, 100 + s / 2, 100 - s / 2, 120.0 if i == 24 else 100.0, 1.0) for i, (d, s) in enumerate(zip(days, spans))]
    bars = spark.createDataFrame(data, "symbol string, d date, open double, high double, low double, close double, volume double")
    events = spark.createDataFrame([("A", days[24], "bmo")], "symbol string, d date, timing string")
    live = T.daily_scan(bars, events, str(days[24]))[1].collect()
    assert [(r.direction, r.session, r.entry_open, r.exit_close, r.pnl_pct) for r in live] == [("long", days[24], None, None, None)]
    # bars after the day of the scan change nothing
    assert T.daily_scan(bars.filter(F.col("d") <= days[24]), events, str(days[24]))[1].collect() == live
    assert T.pead_signals(bars, events).count() == 1 and T.pead_signals(bars.limit(27), events).count() == 0


def test_stream_scan_with_batches_that_split_a_day(spark, tmp_path):
    days = pd.bdate_range("2024-01-01", periods=12).date
    df = spark.createDataFrame([(s, d, float(i)) for s in "ABC" for i, d in enumerate(days)], "symbol string, d date, close double")
    old, new = df.filter(F.col("d") < days[6]), df.filter(F.col("d") >= days[6])
    old.write.parquet(f"{tmp_path}/history/batch=base")
    for s in "ABC":
        new.filter(F.col("symbol") == s).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stream_scan(stream, f"{tmp_path}/history", lambda x: x, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r.symbol, r.d) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r.symbol, r.d) for r in new.collect())


def test_time_of_day_edge_crosses_days(spark):
    rows = [("A", dt.datetime(2024, 1, d, h), 10.0 * d + h) for d in (2, 3) for h in (9, 10)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").withColumn("minute_of_day", F.hour("ts") * 60)
    out = {r.minute_of_day: (r.n, round(r.mean, 6)) for r in G.time_of_day_edge(df, 1, min_n=1).collect()}
    assert out == {540: (2, round((1 / 29 + 1 / 39) / 2, 6)), 600: (1, round(9 / 30, 6))}


def test_folds_and_rows_of_a_panel(spark):
    r = np.random.default_rng(2)
    days = pd.bdate_range("2023-01-02", periods=80).date
    rows = [(d, float(c) + float(r.normal(0, 0.2)), None if i % 10 == 0 else 1.0, int(c), float(c)) for i, d in enumerate(days) for c in r.integers(0, 3, 3)]
    df = spark.createDataFrame(rows, "d date, good double, gaps double, y_cat int, y_amp double")
    m = M.train_amplitude(df, ["good", "gaps"], trees=6, depth=3, folds=3, learners=["random_forest"]).metrics.first()
    assert (m.n_train, m.n_test) == (56 * 3, 24 * 3) and m.cv_mean > 60 and m.cv_std > 0
    folds = M.binary_strong_classifier(df, ["good", "gaps"], iterations=3, depth=2, folds=3, at=0.0)[1].collect()
    assert [f.n for f in folds] == [14 * 3] * 3


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        class conf:
            get = staticmethod(lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")
