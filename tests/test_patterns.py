import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestudy.operators import backtest as T
from tapestudy.operators import candles as C
from tapestudy.operators import features as H
from tapestudy.operators import rules as R
from tapestudy.operators import scans as N
from tapestudy.operators import sessions as G
from tapestudy.operators import stats as A
from tapestudy.operators import series as S

BAR = "symbol string, d date, open double, high double, low double, close double, volume double"


def bars(spark, data, symbol="A"):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(symbol, start + dt.timedelta(days=i), *map(float, x)) for i, x in enumerate(data)], BAR)


def test_strict_engulfing_edges(spark):
    # green 10->11 then red 11.02->9.9: engulfs by 0.02 and 0.1, body 1.12 against 1.0
    good = bars(spark, [(10, 11, 10, 11, 100), (11.02, 11.1, 9.8, 9.9, 100)])
    assert C.engulfing_strict(good).count() == 1
    assert C.engulfing_strict(bars(spark, [(10, 11, 10, 11, 100), (11.02, 11.1, 9.8, 9.9, 99)])).count() == 0  # less volume
    assert C.engulfing_strict(bars(spark, [(10, 11, 10, 11, 0), (11.02, 11.1, 9.8, 9.9, 1)])).count() == 1  # no volume before
    assert C.engulfing_strict(bars(spark, [(10, 11, 10, 11, 100), (11.005, 11.1, 9.8, 9.9, 100)])).count() == 0  # overlap below 0.01
    row = C.engulfing(bars(spark, [(10, 11, 10, 11, 1), (11, 11, 10, 10, 1)])).orderBy("d").collect()[1]
    assert not row.bearish_engulfing  # equal bodies


def test_flat_bars_have_no_doji_and_no_colour(spark):
    out = C.candle_patterns(bars(spark, [(5, 5, 5, 5, 1), (5, 6, 4, 5.05, 1)])).orderBy("d").collect()
    assert (out[0].doji, out[1].doji, out[0].two_green) == (False, True, False)


def test_outcome_skips_missing_sessions(spark):
    rows = C.engulfing_signals(bars(spark, [(10, 11, 10, 11, 1), (11, 11, 9, 9, 1), (9, 9, 8, 8.5, 1)]))
    out = C.engulfing_outcome(rows, threshold_pct=2.0).first()
    assert out.success and abs(out.best_perf - (8 - 9) / 9 * 100) < 1e-9
    last = C.engulfing_outcome(C.engulfing_signals(bars(spark, [(10, 11, 10, 11, 1), (11, 11, 9, 9, 1)])), threshold_pct=2.0).first()
    assert not last.success and last.best_perf is None and last.best_move == 0.0


def test_duration_stops_at_the_first_break(spark):
    data = [(10, 11, 10, 11, 1), (11, 11, 9, 9, 1)] + [(8, 9, 7, c, 1) for c in (8, 8.5, 9.5, 8, 8)]
    rows = C.move_duration(C.engulfing_signals(bars(spark, data)).filter(F.col("d") == dt.date(2024, 1, 2)))
    assert [r.days for r in rows.collect()] == [2]


def test_streak_table_ends(spark):
    closes = [10, 11, 12, 11, 12, 13]
    out = A.streak_table(S.returns(bars(spark, [(c, c, c, c, 1) for c in closes]))).orderBy("start_d").collect()
    assert [(str(r.start_d), str(r.last_in_run), str(r.end_ref), r.length) for r in out] == [
        ("2024-01-02", "2024-01-03", "2024-01-04", 2), ("2024-01-05", "2024-01-06", "2024-01-06", 2)]


def test_entry_sessions_on_one_day(spark):
    mins = [570, 600, 630, 960, 1000]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), m, float(p), p + 1.0, p - 1.0, p + 0.5, 1.0) for m, p in zip(mins, (100, 101, 99, 110, 500))],
                               "symbol string, d date, minute_of_day int, open double, high double, low double, close double, volume double")
    out = {r.horizon: r for r in G.entry_sessions(df, "09:45", (30, 390)).collect()}
    assert (out[30].entry_price, out[30].price, out[390].price, out[390].close_1600) == (101.0, 99.5, 110.5, 110.5)
    assert out[30].calm is None and out[390].calm is False and out[30].gap_pct is None


def test_features_do_not_see_the_session_itself(spark):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2023-01-02", periods=90).date
    long = pd.DataFrame([(s, d, float(x)) for s in ("spx", "vix") for d, x in zip(days, 20 + rng.normal(0, 1, 90).cumsum())], columns=["series", "d", "value"])
    df = spark.createDataFrame(long, "series string, d date, value double")
    cut = days[60]
    changed = df.withColumn("value", F.when(F.col("d") >= F.lit(cut), F.col("value") * 5).otherwise(F.col("value")))
    idx = df.select("d").distinct()
    build = lambda x: H.temporal_features(H.panel(x, ["spx", "vix"], idx)).filter(F.col("d") <= F.lit(cut)).orderBy("d").collect()
    assert build(df) == build(changed)


@pytest.fixture(scope="module")
def ruled(spark):
    rng = np.random.default_rng(11)
    days = pd.bdate_range("2020-01-01", periods=300).date
    y = rng.random(300) < 0.6
    x = {f: rng.normal(0, 1, 300) + (y * w) for f, w in (("f1", 1.5), ("f2", 0.8), ("f3", 0.0), ("f4", 0.4))}
    long = spark.createDataFrame([(f, d, float(v)) for f, vs in x.items() for d, v in zip(days, vs)], "feature string, d date, value double")
    t = spark.createDataFrame([(d, bool(v)) for d, v in zip(days, y)], "d date, hit boolean")
    return long, R.rule_sessions(t, F.col("hit")), x, y


def test_univariate_rules_against_brute_force(ruled):
    long, ses, x, y = ruled
    got = {r.rule_id: (r.n_is, r.n_oos, round(r.precision_oos, 6), r.n_windows_tested, r.n_windows_valid) for r in R.univariate_rules(long, ses, min_precision=60.0).collect()}
    split, size = int(300 * 0.7), 300 // 9
    want = {}
    for f, v in x.items():
        for p in range(10, 91, 10):
            thr = np.percentile(v[:split], p)
            for side, m in (("above", v >= thr), ("below", v <= thr)):
                n_is, n_oos = m[:split].sum(), m[split:].sum()
                if n_is < 15 or n_oos < 6:
                    continue
                p_is, p_oos = y[:split][m[:split]].mean() * 100, y[split:][m[split:]].mean() * 100
                if (p_oos - p_is > 30 and n_oos < 20) or p_oos < 60:
                    continue
                w = [(m[i * size:(i + 1) * size], y[i * size:(i + 1) * size]) for i in range(1, 9)]
                pr = [b[a].mean() * 100 for a, b in w if a.sum() >= 2]
                want[f"{f}:{side}:{p}"] = (n_is, n_oos, round(p_oos, 6), len(pr), sum(q >= 60 for q in pr))
    assert got == want


def test_pair_counts_obey_inclusion_exclusion(ruled):
    long, ses, _, _ = ruled
    lits = R.best_threshold_per_feature(long, ses)
    bits, masks = R.literal_bits(long, ses, lits), R.session_masks(ses)
    pairs = {r.rule_id: r for r in R.combo2_rules(bits, masks, 0, 0, None).collect()}
    single = R.rule_stats(long.join(lits.select("feature", "direction", "threshold"), "feature").filter(
        F.when(F.col("direction") == "above", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))).select(F.col("feature").alias("rule_id"), "d"), ses, 0, 0)
    n = {r.rule_id: r.n_is + r.n_oos for r in single.collect()}
    for a, b in (("f1", "f2"), ("f1", "f3"), ("f2", "f4")):
        both, either = pairs[f"{a} AND {b}"], pairs[f"{a} OR {b}"]
        assert both.n_is + both.n_oos + either.n_is + either.n_oos == n[a] + n[b]


def test_beam_extends_pairs_and_matches_direct_counts(ruled):
    long, ses, x, _ = ruled
    lits = R.best_threshold_per_feature(long, ses)
    bits, masks = R.materialize(R.literal_bits(long, ses, lits)), R.session_masks(ses)
    pairs = R.materialize(R.combo2_rules(bits, masks, 0, 0, None))
    out = R.combo_k_rules(pairs, bits, masks, 4, 0, 0, None, beam={3: (0, 15, 10), 4: (0, 10, 3)}).collect()
    t = {r.feature: (r.direction, r.threshold) for r in lits.collect()}
    on = lambda f: x[f] >= t[f][1] if t[f][0] == "above" else x[f] <= t[f][1]
    assert out and len({r.rule_id for r in out}) == len(out)
    for r in out:
        m = np.logical_and.reduce([on(f) for f in r.features])
        assert (r.n_is, r.n_oos) == (m[:210].sum(), m[210:].sum())


def test_binomial_is_exact(spark):
    def exact(k, n, p):
        pmf = [math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(n + 1)]
        return min(1.0, sum(q for q in pmf if q <= pmf[k] * (1 + 1e-7)))
    cases = [(0, 10, 0.5), (7, 10, 0.5), (30, 50, 0.55), (12, 90, 0.2)]
    df = spark.createDataFrame(cases, "k int, n int, p double")
    for r in df.withColumn("v", N.binomial_two_sided("k", "n", "p")).collect():
        assert abs(r.v - exact(r.k, r.n, r.p)) < 1e-9


def test_level_suffixes_against_brute_force(spark):
    data = [("A", float(lv), r) for lv, r in ((1, .1), (2, -.2), (2, .3), (3, .5), (5, -.1))]
    df = spark.createDataFrame(data, "symbol string, level double, ret double")
    got = {r.level: (r.n, round(r.mean, 9)) for r in N.level_suffixes(df, {"alone": F.lit(True)}).collect()}
    want = {lv: (len(v), round(sum(v) / len(v), 9)) for lv in (1., 2., 3., 5.) for v in [[r for _, x, r in data if x >= lv]]}
    assert got == want


def test_structure_prices(spark):
    q = [("c", 6460.0, 45, 46, 0.9, 4, 5, -0.1), ("c", 6500.0, 20, 21, 0.5, 19, 20, -0.5), ("c", 6540.0, 5, 6, 0.1, 44, 45, -0.9), ("c", 6520.0, 11, 12, 0.3, 30, 31, -0.7), ("c", 6480.0, 31, 32, 0.7, 10, 11, -0.3)]
    df = spark.createDataFrame([(a, *map(float, b)) for a, *b in q], "chain_id string, strike double, call_bid double, call_ask double, call_delta double, put_bid double, put_ask double, put_delta double")
    out = {r.setting: r for r in T.price_structures(df, (("pur", 40.0, None), ("zone", 20.0, 40.0))).collect()}
    assert (out["pur 40"].atm, out["pur 40"].debit, out["pur 40"].credit) == (6500.0, 21 + 20 - 5 - 4, 20 + 19 - 6 - 5)
    assert out["zone 20-40"].debit == 12 + 11 - 5 - 4 and out["zone 20-40"].long_max_gain == 20 - 14
    assert out["pur 40"].is_best and out["pur 40"].short_verdict == "excellent"


def test_interpolation_is_clamped(spark):
    table = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (30.0, 4.0)], "level double, g double")
    pts = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (20.0,), (29.0,), (99.0,)], "x double")
    assert [round(r.g, 9) for r in T.interpolate_by_level(pts, table).orderBy("x").collect()] == [1.0, 1.0, 2.0, 3.0, 3.9, 4.0]


def test_drift_signal_needs_its_window(spark):
    flat = [(100, 101, 99, 100, 1)] * 25
    move = [(100, 100.1, 99.9, 100, 1)] * 5 + [(112, 113, 111, 112, 1)] + [(112, 115, 111, 113 + i, 1) for i in range(5)]
    b = bars(spark, flat + move)
    events = spark.createDataFrame([("A", dt.date(2024, 1, 31), "bmo"), ("A", dt.date(2024, 1, 3), "bmo"), ("A", dt.date(2024, 2, 5), "bmo")], "symbol string, d date, timing string")
    got = T.pead_signals(b, events).collect()
    assert len(got) == 1
    assert (str(got[0].session), got[0].direction, str(got[0].exit_d)) == ("2024-01-31", "long", "2024-02-05")
    assert abs(got[0].pnl_pct - (117 - 112) / 112 * 100) < 1e-9


def test_sparse_features_are_dropped_and_filled_from_the_sample(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    data = [("full", d, float(i)) for i, d in enumerate(days)] + [("gap", d, float(i)) for i, d in enumerate(days) if i not in (2, 9)] + [("rare", d, 1.0) for d in days[:3]]
    df = spark.createDataFrame(data, "feature string, d date, value double")
    got = {(r.feature, r.d): r.value for r in H.drop_sparse_and_impute(df).collect()}
    assert len(got) == 20 and ("rare", days[0]) not in got
    assert got[("gap", days[9])] == got[("gap", days[2])] == float(np.median([0, 1, 3, 4, 5, 6]))
