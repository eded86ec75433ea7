"""Queries of candlestick patterns and outcomes (E)."""

from __future__ import annotations


from ..operators import candles as C
from ..operators import filters as P
from ..operators import series as S
from .inputs import (BARS, EARNINGS, INTRADAY, MARKET, UNIVERSE, VIX, bars, earnings, intraday, market, universe, vix)
from .registry import query
from .series_q import roll

LEADS = ", ".join(f"lead({c}, {h}) OVER w AS {c[0]}{h}" for c in ("close", "low", "high") for h in range(1, 6))

WIDE = f"""wide AS (
  SELECT *, (close - pc) / nullif(pc, 0) * 100.0 AS var_pct, (c1 - close) / nullif(close, 0) * 100.0 AS next_var,
         volume / nullif(vma, 0) AS vol_ratio,
         coalesce(pc > po AND close < open AND open >= pc AND close <= po AND abs(close - open) > abs(pc - po), false) AS bear,
         coalesce(pc < po AND close > open AND open <= pc AND close >= po AND abs(close - open) > abs(pc - po), false) AS bull
  FROM (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, lag(volume) OVER w AS pv, {LEADS}, {roll('avg', 'volume', 20)} AS vma
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS b)"""
BEST = "least(c1, c2, c3, c4, c5, l1, l2, l3, l4, l5)"
SIG = f"""sig AS (
  SELECT *, {BEST} AS best, coalesce({BEST} <= close * (1.0 - 90.0 / 100.0), false) AS success
  FROM wide WHERE bear AND NOT EXISTS (SELECT 1 FROM earnings AS e WHERE e.symbol = wide.symbol AND abs(date_diff('day', e.d, wide.d)) <= 5))"""
SIGNALS = [BARS, EARNINGS, WIDE, SIG]


def signals(spark, sf):
    rows = C.engulfing_signals(bars(spark, sf), earnings=earnings(spark, sf))
    return C.engulfing_outcome(rows, threshold_pct=90.0)


@query("E1_engulfing", "symbol d:s bearish_engulfing:b bullish_engulfing:b",
       "SELECT symbol, d, bear AS bearish_engulfing, bull AS bullish_engulfing FROM wide", [BARS, WIDE])
def e1(spark, sf):
    return C.engulfing(bars(spark, sf))


STRICT = """strict AS (
  SELECT *, (close - pc) / pc * 100.0 AS var_j, volume / nullif(pv, 0) AS vr, abs(close - open) / nullif(abs(pc - po), 0) AS br
  FROM wide WHERE pc > po AND close < open AND open - pc >= 0.01 AND po - close >= 0.01
    AND abs(close - open) >= abs(pc - po) * 1.1 AND NOT coalesce(pv > 0 AND volume < pv, false)
    AND NOT EXISTS (SELECT 1 FROM earnings AS e WHERE e.symbol = wide.symbol AND abs(date_diff('day', e.d, wide.d)) <= 5))"""


@query("E2_engulfing_strict", "symbol d:s close:f var_j:f vol_ratio:f body_ratio:f",
       "SELECT symbol, d, close, var_j, vr AS vol_ratio, br AS body_ratio FROM strict", [BARS, EARNINGS, WIDE, STRICT])
def e2(spark, sf):
    return C.engulfing_strict(bars(spark, sf), earnings=earnings(spark, sf))


PATTERNS = """pat AS (
  SELECT *, coalesce(red AND p_green AND bh >= pbh AND bl <= pbl, false) AS bearish_engulfing,
         coalesce(green AND p_red AND bh >= pbh AND bl <= pbl, false) AS bullish_engulfing,
         coalesce(red AND p_red, false) AS two_red, coalesce(green AND p_green, false) AS two_green,
         coalesce(red AND p_red AND bh >= pbh AND bl <= pbl, false) AS two_red_body_engulf,
         coalesce(bh - bl <= 0.10 * (high - low) AND high > low AND (bh - bl) / nullif(high - low, 0) <= 0.10, false) AS doji,
         bl - low >= 2.0 * (bh - bl) AND high - bh <= bh - bl AS hammer, high - bh >= 2.0 * (bh - bl) AND bl - low <= bh - bl AS shooting_star,
         coalesce(high <= ph AND low >= pl, false) AS inside_bar, coalesce(high >= ph AND low <= pl, false) AS outside_bar,
         coalesce(red AND p_red AND pp_red, false) AS three_black_crows, coalesce(green AND p_green AND pp_green, false) AS three_white_soldiers,
         coalesce(green AND pp_red, false) AS morning_star, coalesce(red AND pp_green, false) AS evening_star
  FROM (SELECT *, lag(red) OVER w AS p_red, lag(green) OVER w AS p_green, lag(red, 2) OVER w AS pp_red, lag(green, 2) OVER w AS pp_green,
               lag(bh) OVER w AS pbh, lag(bl) OVER w AS pbl, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
               (lead(close) OVER w - lead(open) OVER w) / nullif(lead(open) OVER w, 0) AS next_ret
        FROM (SELECT *, close < open AS red, close > open AS green, greatest(open, close) AS bh, least(open, close) AS bl FROM src) AS a
        WINDOW w AS (PARTITION BY symbol ORDER BY ts)) AS b)"""
FLAGS = " ".join(f"{f}:b" for f in C.CANDLE_FLAGS)


@query("E3_candle_patterns", f"symbol d:s {FLAGS}", "SELECT * FROM pat",
       [BARS, "src AS (SELECT *, d AS ts FROM bars)", PATTERNS])
def e3(spark, sf):
    return C.candle_patterns(bars(spark, sf))


E4 = " UNION ALL ".join(
    f"SELECT symbol, '{f}' AS pattern, count(*) FILTER (WHERE {f}) AS n, count(*) FILTER (WHERE {f} AND {{r}} > 0) * 1.0 / nullif(count(*) FILTER (WHERE {f}), 0) AS prob_positive, "
    f"avg({{r}}) FILTER (WHERE {f}) AS mean_next FROM {{t}} GROUP BY symbol" for f in C.CANDLE_FLAGS)


@query("E4_pattern_next_bar", "symbol pattern n:i prob_positive:f mean_next:f", E4.format(r="next_ret", t="pat"),
       [INTRADAY(), "src AS (SELECT * FROM intraday)", PATTERNS])
def e4_bar(spark, sf):
    return C.pattern_next_stats(C.candle_patterns(intraday(spark, sf), order="ts"), order="ts")


@query("E4_pattern_next_day", "symbol pattern n:i prob_positive:f mean_next:f", E4.format(r="day_ret", t="both_"),
       [INTRADAY(), "src AS (SELECT * FROM intraday)", PATTERNS,
        """days AS (SELECT symbol, d, (lead(c) OVER w - lead(o) OVER w) / nullif(lead(o) OVER w, 0) AS day_ret
           FROM (SELECT symbol, d, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM intraday GROUP BY symbol, d) AS x
           WINDOW w AS (PARTITION BY symbol ORDER BY d))""",
        "both_ AS (SELECT pat.*, days.day_ret FROM pat JOIN days ON pat.symbol = days.symbol AND pat.d = days.d)"])
def e4_day(spark, sf):
    return C.pattern_next_stats(C.candle_patterns(intraday(spark, sf), order="ts"), horizon="next_day", order="ts")


@query("E5_color_sequence", "symbol d:s sequence:b",
       """SELECT symbol, d, coalesce(lag(close < open, 2) OVER w AND lag(close < open) OVER w AND close > open, false) AS sequence
          FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)""", [BARS])
def e5(spark, sf):
    return C.color_sequence(bars(spark, sf), ["red", "red", "green"])


@query("E6_sequence_next_mean", "symbol n:i mean_next:f",
       """SELECT symbol, count(*) AS n, avg(nx) AS mean_next FROM (
          SELECT symbol, d, (lead(mc) OVER w - mc) / mc AS nx, coalesce(lag(red) OVER w AND red, false) AS hit
          FROM (SELECT *, CASE WHEN d < DATE '2001-06-01' THEN close END AS mc, CASE WHEN d < DATE '2001-06-01' THEN close < open END AS red FROM bars WHERE d <= DATE '2001-06-01') AS a
          WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS b WHERE hit GROUP BY symbol""", [BARS])
def e6(spark, sf):
    known = P.ex_ante_mask_daily(bars(spark, sf), "2001-06-01")
    # the mask hides the close of the decision day, so the session before it has no next return yet
    return C.sequence_next_mean(known, ["red", "red"])


@query("E7_engulfing_outcome", "symbol d:s success:b best_perf:f best_move:f",
       "SELECT symbol, d, success, (best - close) / close * 100.0 AS best_perf, greatest(coalesce(-((best - close) / close * 100.0), 0), 0) AS best_move FROM sig", SIGNALS)
def e7(spark, sf):
    return signals(spark, sf)


@query("E8_threshold_curve", "symbol threshold:f n_total:i n_success:i rate:f target_met:b",
       f"""SELECT symbol, t AS threshold, n_total, n_success, rate, coalesce(t = min(CASE WHEN rate >= 99.0 THEN t END) OVER (PARTITION BY symbol), false) AS target_met
          FROM (SELECT symbol, t, count(*) AS n_total, count(*) FILTER (WHERE best <= close * (1.0 - t / 100.0)) AS n_success,
                count(*) FILTER (WHERE best <= close * (1.0 - t / 100.0)) * 100.0 / count(*) AS rate
                FROM sig CROSS JOIN (SELECT range * CAST(0.5 AS DOUBLE) AS t FROM range(1, 31)) AS x GROUP BY symbol, t) AS y""", SIGNALS)
def e8(spark, sf):
    return C.threshold_curve(signals(spark, sf), target=99.0)


@query("E9_outcome_by_bucket", "symbol bucket n:i n_success:i rate:f",
       """SELECT s.symbol, x.bucket, count(*) FILTER (WHERE v.close >= lo AND v.close < hi) AS n,
          count(*) FILTER (WHERE v.close >= lo AND v.close < hi AND success) AS n_success,
          coalesce(count(*) FILTER (WHERE v.close >= lo AND v.close < hi AND success) * 100.0 / nullif(count(*) FILTER (WHERE v.close >= lo AND v.close < hi), 0), 0) AS rate
          FROM sig AS s JOIN vix AS v ON s.d = v.d
          CROSS JOIN (VALUES ('0-15', 0, 15), ('15-20', 15, 20), ('20-25', 20, 25), ('25-30', 25, 30), ('30-100', 30, 100)) AS x(bucket, lo, hi)
          GROUP BY s.symbol, x.bucket""", [*SIGNALS, VIX])
def e9(spark, sf):
    return C.outcome_by_bucket(signals(spark, sf), vix(spark, sf))


@query("E10_outcome_by_year", "symbol year:i n:i n_success:i n_fail:i rate:f is_best:b is_worst:b",
       """SELECT *, coalesce(year IS NOT NULL AND row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN year IS NOT NULL THEN rate END DESC NULLS LAST, year) = 1, false) AS is_best,
          coalesce(year IS NOT NULL AND row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN year IS NOT NULL THEN rate END ASC NULLS LAST, year) = 1, false) AS is_worst
          FROM (SELECT symbol, y AS year, count(*) AS n, count(*) FILTER (WHERE success) AS n_success, count(*) FILTER (WHERE NOT success) AS n_fail,
                       count(*) FILTER (WHERE success) * 100.0 / count(*) AS rate
                FROM (SELECT *, year(d) AS y FROM sig) AS s GROUP BY GROUPING SETS ((symbol, y), (symbol))) AS g""", SIGNALS)
def e10(spark, sf):
    return C.outcome_by_year(signals(spark, sf))


@query("E11_outcome_multi_period", "symbol year:i n:i n_success:i rate:f",
       """SELECT symbol, year(d) AS year, count(*) AS n, count(*) FILTER (WHERE success) AS n_success, avg(CAST(success AS INT)) * 100.0 AS rate
          FROM sig WHERE year(d) IN (1996, 1999) GROUP BY symbol, year(d)""", SIGNALS)
def e11(spark, sf):
    return C.outcome_multi_period(signals(spark, sf), [1996, 1999])


@query("E12_volume_gate_curve", "symbol quantile:f min_vol_ratio:f n:i n_success:i rate:f target_met:b",
       """SELECT *, coalesce(quantile = min(CASE WHEN rate >= 85.0 THEN quantile END) OVER (PARTITION BY symbol), false) AS target_met
          FROM (SELECT s.symbol, q.q AS quantile, q.v AS min_vol_ratio, count(*) FILTER (WHERE s.vol_ratio >= q.v) AS n,
                count(*) FILTER (WHERE s.vol_ratio >= q.v AND success) AS n_success,
                count(*) FILTER (WHERE s.vol_ratio >= q.v AND success) * 100.0 / nullif(count(*) FILTER (WHERE s.vol_ratio >= q.v), 0) AS rate
                FROM sig AS s JOIN (SELECT symbol, unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q,
                  unnest(quantile_cont(vol_ratio, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS v FROM sig GROUP BY symbol) AS q ON s.symbol = q.symbol
                GROUP BY s.symbol, q.q, q.v) AS g WHERE n >= 5""", SIGNALS)
def e12(spark, sf):
    return C.volume_gate_curve(signals(spark, sf), target=85.0)


DAYS = """dur AS (SELECT *, CASE WHEN NOT coalesce(c1 < close, false) THEN 0 WHEN NOT coalesce(c2 < close, false) THEN 1
          WHEN NOT coalesce(c3 < close, false) THEN 2 WHEN NOT coalesce(c4 < close, false) THEN 3 WHEN NOT coalesce(c5 < close, false) THEN 4 ELSE 5 END AS days FROM sig)"""


@query("E13_move_duration", "symbol n:i median_days:f mean_days:f",
       "SELECT symbol, count(*) AS n, median(days) AS median_days, avg(days) AS mean_days FROM dur GROUP BY symbol", [*SIGNALS, DAYS])
def e13(spark, sf):
    return C.duration_summary(C.move_duration(signals(spark, sf)))


@query("E13_duration_distribution", "symbol days:i n:i", "SELECT symbol, days, count(*) AS n FROM dur GROUP BY symbol, days", [*SIGNALS, DAYS])
def e13_distribution(spark, sf):
    return C.duration_distribution(C.move_duration(signals(spark, sf)))


@query("E14_after_signal_perf", "symbol n:i avg_next:f med_next:f pct_pos_next:f",
       """SELECT symbol, count(next_var) AS n, avg(next_var) AS avg_next, median(next_var) AS med_next,
          count(*) FILTER (WHERE next_var > 0) * 100.0 / count(next_var) AS pct_pos_next FROM sig GROUP BY symbol""", SIGNALS)
def e14(spark, sf):
    return C.after_signal_perf(signals(spark, sf))


NEAR2 = """near AS (SELECT series, day AS d, value FROM (
  SELECT series, value, d + CAST(o AS INTEGER) AS day, row_number() OVER (PARTITION BY series, d + CAST(o AS INTEGER) ORDER BY abs(o), o) AS rn
  FROM market CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS o) AS x) AS y WHERE rn = 1)"""


@query("E15_failure_context", "symbol series n_fail:i n_success:i mean_fail:f mean_success:f diff:f notable:b",
       """SELECT *, mean_fail - mean_success AS diff, abs(mean_fail - mean_success) > CASE WHEN std > 0 THEN std ELSE 1 END * 0.5 AS notable
          FROM (SELECT s.symbol, n.series, count(*) FILTER (WHERE NOT success) AS n_fail, count(*) FILTER (WHERE success) AS n_success,
                avg(n.value) FILTER (WHERE NOT success) AS mean_fail, avg(n.value) FILTER (WHERE success) AS mean_success,
                stddev_samp(n.value) FILTER (WHERE success) AS std
                FROM sig AS s JOIN near AS n ON s.d = n.d GROUP BY s.symbol, n.series) AS g WHERE n_fail >= 2 AND n_success >= 2""",
       [*SIGNALS, MARKET, NEAR2])
def e15(spark, sf):
    return C.failure_context(signals(spark, sf), market(spark, sf))


@query("E15_failure_profile", "symbol n_fail:i vol_ratio_fail:f vol_ratio_success:f weekday_fail:i month_fail:i",
       """SELECT s.symbol, count(*) FILTER (WHERE NOT success) AS n_fail, avg(vol_ratio) FILTER (WHERE NOT success) AS vol_ratio_fail,
          avg(vol_ratio) FILTER (WHERE success) AS vol_ratio_success, any_value(w.k) AS weekday_fail, any_value(m.k) AS month_fail
          FROM sig AS s
          LEFT JOIN (SELECT symbol, k FROM (SELECT symbol, isodow(d) - 1 AS k, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, isodow(d) - 1) AS rn
                     FROM sig WHERE NOT success GROUP BY symbol, isodow(d) - 1) AS a WHERE rn = 1) AS w ON w.symbol = s.symbol
          LEFT JOIN (SELECT symbol, k FROM (SELECT symbol, month(d) AS k, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, month(d)) AS rn
                     FROM sig WHERE NOT success GROUP BY symbol, month(d)) AS a WHERE rn = 1) AS m ON m.symbol = s.symbol
          GROUP BY s.symbol""", SIGNALS)
def e15_profile(spark, sf):
    return C.failure_profile(signals(spark, sf))


@query("E16_signal_last", "symbol last_d:s close:f var_pct:f next_var:f n_total:i",
       """SELECT symbol, max(d) AS last_d, arg_max(close, d) AS close, arg_max(var_pct, d) AS var_pct,
          first(next_var ORDER BY d DESC) AS next_var, count(*) AS n_total FROM sig GROUP BY symbol""", SIGNALS)
def e16_last(spark, sf):
    return C.signal_last(signals(spark, sf))


@query("E16_signal_count", "symbol n:i total:i pct:f pct_neg_next:f",
       """SELECT symbol, count(*) FILTER (WHERE bear) AS n, count(*) AS total, count(*) FILTER (WHERE bear) * 100.0 / count(*) AS pct,
          count(*) FILTER (WHERE bear AND next_var < 0) * 100.0 / count(*) FILTER (WHERE bear AND next_var IS NOT NULL) AS pct_neg_next
          FROM wide GROUP BY symbol""", [BARS, WIDE])
def e16_count(spark, sf):
    return C.signal_count(C.engulfing(S.returns(bars(spark, sf))), "bearish_engulfing")


BBE = """bbe AS (SELECT symbol, d, close AS close_j0, c1 AS close_j1, c5 AS close_j5, (c1 - close) / close * 100.0 AS r1, (c5 - close) / close * 100.0 AS r5,
  (l1 - close) / close * 100.0 AS low1, CASE WHEN c3 IS NOT NULL THEN (least(l1, l2, l3) - close) / close * 100.0 END AS low3,
  CASE WHEN c5 IS NOT NULL THEN (least(l1, l2, l3, l4, l5) - close) / close * 100.0 END AS low5
  FROM strict WHERE c1 IS NOT NULL AND close > 0)"""


@query("E17_bbe_signal_table", "symbol d:s close_j0:f close_j5:f return_close_j1_pct:f return_close_j5_pct:f return_lowmin_j3_pct:f return_lowmin_j5_pct:f",
       """SELECT symbol, d, close_j0, close_j5, r1 AS return_close_j1_pct, r5 AS return_close_j5_pct, low3 AS return_lowmin_j3_pct,
          low5 AS return_lowmin_j5_pct FROM bbe""", [BARS, EARNINGS, WIDE, STRICT, BBE])
def e17(spark, sf):
    return C.bbe_signal_table(bars(spark, sf), earnings(spark, sf))


@query("E18_rank_tickers", "rank:i symbol n_signals:i mean_ret:f median_ret:f worst:f best:f win_rate:f fails:i sector",
       """SELECT row_number() OVER (ORDER BY win_rate DESC, n_signals DESC, g.symbol) AS rank, g.*, u.sector FROM (
          SELECT symbol, count(*) AS n_signals, avg(low5) AS mean_ret, median(low5) AS median_ret, min(low5) AS worst, max(low5) AS best,
          count(*) FILTER (WHERE low5 <= -85.0) * 100.0 / count(*) AS win_rate, count(*) FILTER (WHERE low5 > -85.0) AS fails
          FROM bbe WHERE low5 IS NOT NULL GROUP BY symbol) AS g LEFT JOIN universe AS u ON g.symbol = u.symbol WHERE n_signals >= 3""",
       [BARS, EARNINGS, WIDE, STRICT, BBE, UNIVERSE])
def e18(spark, sf):
    return C.rank_tickers(C.bbe_signal_table(bars(spark, sf), earnings(spark, sf)), universe(spark, sf), threshold_pct=-85.0, min_signals=3)


@query("E18_rank_tickers_next_day", "rank:i symbol n_signals:i j1_mean:f j1_median:f hit_rate:f j1_worst:f j1_best:f",
       """SELECT row_number() OVER (ORDER BY j1_mean ASC NULLS LAST, n_signals DESC, symbol) AS rank, * FROM (
          SELECT u.symbol, count(r1) AS n_signals, avg(r1) AS j1_mean, median(r1) AS j1_median, count(*) FILTER (WHERE r1 < 0) * 100.0 / nullif(count(r1), 0) AS hit_rate,
          min(r1) AS j1_worst, max(r1) AS j1_best FROM universe AS u LEFT JOIN bbe AS b ON u.symbol = b.symbol GROUP BY u.symbol) AS g""",
       [BARS, EARNINGS, WIDE, STRICT, BBE, UNIVERSE])
def e18_next_day(spark, sf):
    return C.rank_tickers_next_day(C.bbe_signal_table(bars(spark, sf), earnings(spark, sf)), universe(spark, sf))


@query("E19_signals_in_week", "symbol d:s close_j0:f return_close_j1_pct:f return_lowmin_j5_pct:f win_rate_j1:f win_rate_j5:f",
       """SELECT s.symbol, s.d, s.close AS close_j0, (s.c1 - s.close) / s.close * 100.0 AS return_close_j1_pct,
          (least(s.l1, s.l2, s.l3, s.l4, s.l5) - s.close) / s.close * 100.0 AS return_lowmin_j5_pct,
          coalesce(h.w1, 0) AS win_rate_j1, coalesce(h.w5, 0) AS win_rate_j5
          FROM strict AS s LEFT JOIN (SELECT symbol, count(*) FILTER (WHERE low1 <= -50) * 100.0 / nullif(count(low1), 0) AS w1,
               count(*) FILTER (WHERE low5 <= -50) * 100.0 / nullif(count(low5), 0) AS w5 FROM bbe GROUP BY symbol) AS h ON s.symbol = h.symbol
          WHERE s.d BETWEEN DATE '2000-07-10' AND DATE '2000-07-16'""", [BARS, EARNINGS, WIDE, STRICT, BBE])
def e19(spark, sf):
    b, e = bars(spark, sf), earnings(spark, sf)
    return C.signals_in_week(b, "2000-07-10", e, C.bbe_signal_table(b, e), -50.0)


FILTERED = """filt AS (
  SELECT w.*, {best} AS best FROM (SELECT *, {ma} AS ma20 FROM wide) AS w LEFT JOIN vix AS v ON w.d = v.d
  WHERE {shape} AND abs(w.close - w.open) >= abs(pc - po) * 1.1 AND NOT coalesce(pv > 0 AND w.volume < pv, false)
    AND NOT coalesce(w.high > w.low AND abs(w.close - w.open) / nullif(w.high - w.low, 0) * 100.0 < 40.0, false)
    AND NOT coalesce(w.volume < vma, false) {extra}
    AND NOT EXISTS (SELECT 1 FROM earnings AS e WHERE e.symbol = w.symbol AND abs(date_diff('day', e.d, w.d)) <= 5))"""
FILT_BEAR = FILTERED.format(
    best="least(c1, c2, c3, l1, l2, l3)", ma=roll("avg", "close", 20), shape="pc > po AND w.close < w.open AND w.close < po",
    extra="AND NOT coalesce(w.open < pc * 0.999, false) AND NOT coalesce(w.close > ma20, false) AND NOT coalesce(v.open < 15.0, false)")
FILT_BULL = FILTERED.format(best="greatest(c1, c2, c3, h1, h2, h3)", ma=roll("avg", "close", 20),
                            shape="pc < po AND w.close > w.open AND w.close > po AND w.open <= pc * 1.001", extra="")
FILT_COLS = "symbol d:s close:f var_j:f vol_ratio:f body_ratio:f best_perf:f evaluable:b success:b"
FILT_SQL = """SELECT symbol, d, close, (close - pc) / pc * 100.0 AS var_j, volume / nullif(pv, 0) AS vol_ratio, abs(close - open) / nullif(abs(pc - po), 0) AS body_ratio,
          (best - close) / close * 100.0 AS best_perf, best IS NOT NULL AS evaluable, coalesce({hit}, false) AS success FROM filt"""


@query("E20_engulfing_filtered", FILT_COLS, FILT_SQL.format(hit="best <= close * (1.0 - 80.0 / 100.0)"), [BARS, EARNINGS, VIX, WIDE, FILT_BEAR])
def e20(spark, sf):
    return C.engulfing_filtered(bars(spark, sf), earnings=earnings(spark, sf), vix=vix(spark, sf), require_gap=True, min_body_pct=40.0, ma20=True,
                                vol_ma20=True, vix_min=15.0, horizon=3, threshold_pct=80.0)


@query("E20_engulfing_filtered_bullish", FILT_COLS, FILT_SQL.format(hit="best >= close * (1.0 + 20.0 / 100.0)"), [BARS, EARNINGS, VIX, WIDE, FILT_BULL])
def e20_bull(spark, sf):
    return C.engulfing_filtered(bars(spark, sf), "bullish", earnings=earnings(spark, sf), min_body_pct=40.0, vol_ma20=True, horizon=3, threshold_pct=20.0)


@query("E20_win_rate", "symbol n_signals:i n_evaluable:i n_win:i win_rate:f",
       """SELECT symbol, count(*) AS n_signals, count(best) AS n_evaluable, count(*) FILTER (WHERE best <= close * 0.2) AS n_win,
          coalesce(count(*) FILTER (WHERE best <= close * 0.2) * 100.0 / nullif(count(best), 0), 0) AS win_rate FROM filt GROUP BY symbol""",
       [BARS, EARNINGS, VIX, WIDE, FILT_BEAR])
def e20_rate(spark, sf):
    return C.win_rate(e20(spark, sf))


@query("E21_signal_index_context", "symbol d:s index_jm1:f index_j0:f index_j1:f",
       """SELECT s.symbol, s.d, i.rm AS index_jm1, i.r AS index_j0, i.rp AS index_j1 FROM sig AS s LEFT JOIN (
          SELECT d, r, lag(r) OVER (ORDER BY d) AS rm, lead(r) OVER (ORDER BY d) AS rp FROM (
          SELECT d, (close - lag(close) OVER (ORDER BY d)) / lag(close) OVER (ORDER BY d) * 100.0 AS r FROM vix) AS a) AS i ON s.d = i.d""", [*SIGNALS, VIX])
def e21(spark, sf):
    return C.signal_index_context(signals(spark, sf), vix(spark, sf))
