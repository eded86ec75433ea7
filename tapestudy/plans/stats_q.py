"""Queries of aggregations and event-study summaries (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles as C
from ..operators import filters as P
from ..operators import joins as J
from ..operators import series as S
from ..operators import stats as A
from .candles_q import NEAR2
from .inputs import BARS, MARKET, VIX, bars, market, vix
from .registry import query
from .series_q import RETURNS, roll

VRET = """vret AS (SELECT *, (close - prev_close) / prev_close * 100.0 AS var_pct, (next_close - close) / close * 100.0 AS next_var
  FROM (SELECT *, lag(close) OVER (ORDER BY d) AS prev_close, lead(close) OVER (ORDER BY d) AS next_close FROM vix) AS v)"""
RET = [BARS, RETURNS]


def ret(spark, sf):
    return S.returns(bars(spark, sf))


def vret(spark, sf):
    return S.returns(vix(spark, sf))


def high_vix(spark, sf, level=25.0):
    return P.dates_where(vix(spark, sf), F.col("close") > level)


@query("F1_event_stats", "symbol n:i mean_var:f mean_pts:f pct_bull:f pct_bear:f best_d:s best:f worst_d:s worst:f",
       """SELECT symbol, count(*) AS n, avg(var_pct) AS mean_var, avg(close - prev_close) AS mean_pts, avg(CASE WHEN var_pct > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_bull,
          100.0 - avg(CASE WHEN var_pct > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_bear, first(d ORDER BY var_pct DESC, d) AS best_d, max(var_pct) AS best,
          first(d ORDER BY var_pct, d) AS worst_d, min(var_pct) AS worst FROM ret WHERE volume > 60 AND var_pct IS NOT NULL GROUP BY symbol""", RET)
def f1(spark, sf):
    return A.event_stats(bars(spark, sf), F.col("volume") > 60)


@query("F1_event_stats_open_close", "symbol n:i mean_var:f pct_bull:f pct_bear:f best_d:s worst_d:s",
       """SELECT symbol, count(*) AS n, avg(v) AS mean_var, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_bull, avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_bear,
          first(d ORDER BY v DESC, d) AS best_d, first(d ORDER BY v, d) AS worst_d FROM (SELECT *, (close - open) / open * 100.0 AS v FROM bars) AS b GROUP BY symbol""", [BARS])
def f1_open(spark, sf):
    return A.event_stats(bars(spark, sf), return_type="open_to_close")


@query("F2_conditional_next", "symbol n:i pct_pos_next:f mean_next:f median_next:f",
       """SELECT symbol, count(*) AS n, count(*) FILTER (WHERE next_var > 0) * 100.0 / count(next_var) AS pct_pos_next, avg(next_var) AS mean_next, median(next_var) AS median_next
          FROM ret WHERE var_pct < -20 AND d IN (SELECT d FROM vix WHERE close > 25) GROUP BY symbol""", [*RET, VIX])
def f2(spark, sf):
    """The flagship question: the next move of every symbol after a fall on days of a high volatility level."""
    rows = P.restrict_to_dates(ret(spark, sf), high_vix(spark, sf))
    return A.conditional_next(rows, F.col("var_pct") < -20)


@query("F3_multi_threshold_next", "symbol threshold:f total:i n:i pct_of_total:f pct_pos_next:f mean_next:f is_best:b",
       """SELECT *, coalesce(row_number() OVER (PARTITION BY symbol ORDER BY pct_pos_next DESC NULLS LAST, threshold) = 1 AND pct_pos_next > 0, false) AS is_best FROM (
          SELECT symbol, t AS threshold, count(*) AS total, count(*) FILTER (WHERE var_pct <= -t) AS n, count(*) FILTER (WHERE var_pct <= -t) * 100.0 / count(*) AS pct_of_total,
          count(*) FILTER (WHERE var_pct <= -t AND next_var > 0) * 100.0 / nullif(count(next_var) FILTER (WHERE var_pct <= -t), 0) AS pct_pos_next,
          avg(next_var) FILTER (WHERE var_pct <= -t) AS mean_next FROM ret CROSS JOIN (SELECT unnest([5.0, 20.0, 40.0, 60.0, 80.0, 95.0]) AS t) AS x GROUP BY symbol, t) AS g""", RET)
def f3(spark, sf):
    return A.multi_threshold_next(ret(spark, sf), [5.0, 20.0, 40.0, 60.0, 80.0, 95.0])


@query("F3_threshold_next_direction", "symbol threshold:f n:i hits:i pct_next:f",
       """SELECT symbol, t AS threshold, count(*) FILTER (WHERE var_pct >= t) AS n, count(*) FILTER (WHERE var_pct >= t AND next_close < close) AS hits,
          coalesce(count(*) FILTER (WHERE var_pct >= t AND next_close < close) * 100.0 / nullif(count(*) FILTER (WHERE var_pct >= t), 0), 0) AS pct_next
          FROM ret CROSS JOIN (SELECT unnest([10.0, 50.0, 100.0]) AS t) AS x WHERE prev_close IS NOT NULL AND next_close IS NOT NULL AND d IN (SELECT d FROM vix WHERE close > 25)
          GROUP BY symbol, t""", [*RET, VIX])
def f3_direction(spark, sf):
    return A.threshold_next_direction(ret(spark, sf), [10.0, 50.0, 100.0], is_drop=False, next_positive=False, dates=high_vix(spark, sf))


@query("F4_filter_moves", "symbol n:i pct_pos_next:f mean_next:f mean_move:f",
       """SELECT symbol, count(*) AS n, count(*) FILTER (WHERE next_var > 0) * 100.0 / count(next_var) AS pct_pos_next, avg(next_var) AS mean_next, avg(m) AS mean_move
          FROM (SELECT *, (close - open) / open * 100.0 AS m FROM ret) AS r WHERE m <= -30 GROUP BY symbol""", RET)
def f4(spark, sf):
    rows = A.filter_moves(ret(spark, sf), "intraday_drop", 30.0)
    return A.conditional_next(rows, F.lit(True)).join(rows.groupBy("symbol").agg(F.avg("move").alias("mean_move")), "symbol")


GROUPED = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean_var DESC, {k}) AS rank FROM (
          SELECT symbol, {k}, count(*) AS n, avg(var_pct) AS mean_var, median(var_pct) AS median_var, count(*) FILTER (WHERE var_pct > 0) * 100.0 / count(*) AS pct_positive
          FROM ret {w} GROUP BY symbol, {k}) AS g"""


@query("F5_weekday_stats", "symbol dow:i n:i mean_var:f median_var:f pct_positive:f rank:i", GROUPED.format(k="dow", w="WHERE dow < 5"), RET)
def f5(spark, sf):
    return A.weekday_stats(ret(spark, sf))


@query("F6_month_stats", "symbol month:i n:i mean_var:f median_var:f pct_positive:f rank:i", GROUPED.format(k="month", w=""), RET)
def f6(spark, sf):
    return A.month_stats(ret(spark, sf))


@query("F7_period_perf_year", "symbol period:s base:f last_close:f perf_pct:f",
       """SELECT *, (last_close - base) / base * 100.0 AS perf_pct FROM (SELECT symbol, CAST(date_trunc('year', d) AS DATE) AS period, arg_min(open, d) AS base, arg_max(close, d) AS last_close
          FROM bars GROUP BY 1, 2) AS g""", [BARS])
def f7_year(spark, sf):
    return A.period_perf(bars(spark, sf))


@query("F7_period_perf_month", "symbol period:s base:f last_close:f perf_pct:f",
       """SELECT *, (last_close - base) / base * 100.0 AS perf_pct FROM (SELECT symbol, CAST(date_trunc('month', d) AS DATE) AS period, arg_min(close, d) AS base, arg_max(close, d) AS last_close
          FROM bars GROUP BY 1, 2) AS g""", [BARS])
def f7_month(spark, sf):
    return A.period_perf(bars(spark, sf), "month", "first_close")


@query("F8_compare", "symbol n_a:i n_b:i mean_a:f mean_b:f diff:f leader",
       """SELECT *, abs(mean_a - mean_b) AS diff, CASE WHEN mean_a >= mean_b THEN 'a' ELSE 'b' END AS leader FROM (
          SELECT symbol, count(*) FILTER (WHERE year = 1997) AS n_a, count(*) FILTER (WHERE year = 1998) AS n_b, avg(var_pct) FILTER (WHERE year = 1997) AS mean_a,
          avg(var_pct) FILTER (WHERE year = 1998) AS mean_b FROM ret GROUP BY symbol) AS g""", RET)
def f8(spark, sf):
    return A.compare_means(ret(spark, sf), F.col("year") == 1997, F.col("year") == 1998, "var_pct")


@query("F8_compare_series", "symbol n:i mean_a:f mean_b:f diff:f leader",
       """SELECT *, abs(mean_a - mean_b) AS diff, CASE WHEN mean_a >= mean_b THEN 'a' ELSE 'b' END AS leader FROM (
          SELECT a.symbol, count(*) AS n, avg(a.r) AS mean_a, avg(b.r) AS mean_b
          FROM (SELECT symbol, d, (lead(close, 21) OVER (PARTITION BY symbol ORDER BY d) - close) / close AS r FROM bars) AS a
          JOIN (SELECT d, (lead(close, 21) OVER (ORDER BY d) - close) / close AS r FROM vix) AS b ON a.d = b.d WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.symbol) AS g""", [BARS, VIX])
def f8_series(spark, sf):
    return A.compare_series(S.forward_return(bars(spark, sf), 21), S.forward_return(vix(spark, sf), 21), "fwd_return")


@query("F9_count_days", "symbol n:i total:i n_days:i pct:f",
       "SELECT symbol, count(*) FILTER (WHERE var_pct < 0) AS n, count(*) AS total, count(DISTINCT d) FILTER (WHERE var_pct < 0) AS n_days, count(*) FILTER (WHERE var_pct < 0) * 100.0 / count(*) AS pct FROM ret GROUP BY symbol", RET)
def f9(spark, sf):
    return A.count_days(ret(spark, sf), F.col("var_pct") < 0)


@query("F10_worst_day", "symbol year:i d:s var_pct:f close:f",
       "SELECT symbol, year, d, var_pct, close FROM ret WHERE var_pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, year ORDER BY var_pct, d) = 1", RET)
def f10_worst(spark, sf):
    return A.extreme_days(ret(spark, sf), "down")


@query("F10_best_day", "symbol d:s var_pct:f close:f",
       "SELECT symbol, d, var_pct, close FROM ret WHERE var_pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY var_pct DESC, d) = 1", RET)
def f10_best(spark, sf):
    return A.extreme_days(ret(spark, sf), "up", by_year=False)


@query("F11_lookup", "symbol d:s close:f var_pct:f vol_ratio:f bearish_engulfing:b context_close:f",
       f"""SELECT r.symbol, r.d, r.close, r.var_pct, r.vol_ratio, r.eng AS bearish_engulfing, v.close AS context_close FROM (
          SELECT *, volume / {roll('avg', 'volume', 20)} AS vol_ratio, coalesce(pc > po AND close < open AND open >= pc AND close <= po AND abs(close - open) > abs(pc - po), false) AS eng
          FROM (SELECT *, prev_close AS pc, lag(open) OVER (PARTITION BY symbol ORDER BY d) AS po FROM ret) AS x) AS r LEFT JOIN vix AS v ON r.d = v.d WHERE r.d = DATE '1998-06-15'""", [*RET, VIX])
def f11(spark, sf):
    return A.lookup(C.engulfing(S.volume_features(ret(spark, sf))), "1998-06-15", context=vix(spark, sf))


@query("F12_streak_table", "symbol start_d:s last_in_run:s end_ref:s length:i rank:i mean_length:f",
       """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY length DESC, start_d) AS rank, avg(length) OVER (PARTITION BY symbol) AS mean_length FROM (
          SELECT symbol, min(d) AS start_d, max(d) AS last_in_run, coalesce(last(nd ORDER BY d), max(d)) AS end_ref, count(*) AS length FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - row_number() OVER (PARTITION BY symbol, up ORDER BY d) AS g
            FROM (SELECT symbol, d, coalesce(var_pct > 0, false) AS up, lead(d) OVER (PARTITION BY symbol ORDER BY d) AS nd FROM ret) AS a) AS b
          WHERE up GROUP BY symbol, g) AS c""", RET)
def f12(spark, sf):
    return A.streak_table(ret(spark, sf), "up")


@query("F13_bias", "symbol n:i n_pos:i n_neg:i pct_pos:f mean_var:f median_var:f skew:f bias index_pct_pos:f index_mean_var:f",
       """SELECT *, n - n_pos AS n_neg, CASE WHEN pct_pos > 52 THEN 'up' WHEN pct_pos < 48 THEN 'down' ELSE 'neutral' END AS bias,
          (SELECT count(*) FILTER (WHERE var_pct > 0) * 100.0 / count(*) FROM vret) AS index_pct_pos, (SELECT avg(var_pct) FROM vret) AS index_mean_var FROM (
          SELECT symbol, count(*) AS n, count(*) FILTER (WHERE var_pct > 0) AS n_pos, count(*) FILTER (WHERE var_pct > 0) * 100.0 / count(*) AS pct_pos, avg(var_pct) AS mean_var,
          median(var_pct) AS median_var, skewness(var_pct) AS skew FROM ret GROUP BY symbol) AS g""", [*RET, VIX, VRET])
def f13(spark, sf):
    return A.bias(ret(spark, sf), vret(spark, sf))


@query("F14_correlation", "symbol n:i corr:f",
       "SELECT r.symbol, count(*) AS n, corr(r.var_pct, v.var_pct) AS corr FROM ret AS r JOIN vret AS v ON r.d = v.d WHERE r.var_pct IS NOT NULL AND v.var_pct IS NOT NULL GROUP BY r.symbol", [*RET, VIX, VRET])
def f14(spark, sf):
    return A.correlation(ret(spark, sf), vret(spark, sf))


@query("F15_correlation_scan", "symbol series n:i corr:f strength rank:i",
       """SELECT *, CASE WHEN abs(corr) > 0.6 THEN 'strong' WHEN abs(corr) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength,
          row_number() OVER (PARTITION BY symbol ORDER BY abs(corr) DESC, series) AS rank FROM (
          SELECT r.symbol, n.series, count(*) AS n, corr(r.var_pct, n.value) AS corr FROM ret AS r JOIN near AS n ON r.d = n.d WHERE r.var_pct IS NOT NULL GROUP BY r.symbol, n.series) AS g
          WHERE n >= 30 AND abs(corr) > 0.01""", [*RET, MARKET, NEAR2])
def f15(spark, sf):
    return A.correlation_scan(ret(spark, sf), market(spark, sf), min_abs=0.01)


@query("F16_correlation_catalog", "a b n:i corr:f abs_corr:f first_d:s last_d:s",
       """SELECT *, abs(corr) AS abs_corr FROM (SELECT a, b, count(*) AS n, corr(x, y) AS corr, min(d) AS first_d, max(d) AS last_d FROM (
          SELECT a.symbol AS a, b.symbol AS b, a.d, a.var_pct AS x, b.var_pct AS y FROM ret AS a JOIN ret AS b ON a.d = b.d AND a.symbol < b.symbol AND substr(a.symbol, 1, 1) <> substr(b.symbol, 1, 1)
          WHERE a.var_pct IS NOT NULL AND b.var_pct IS NOT NULL QUALIFY a.d >= max(a.d) OVER (PARTITION BY a.symbol, b.symbol) - INTERVAL 7 MONTH) AS j GROUP BY a, b) AS g WHERE n >= 20""", RET)
def f16(spark, sf):
    r = ret(spark, sf)
    fam = r.select(F.col("symbol").alias("series"), F.substring("symbol", 1, 1).alias("family")).distinct()
    return A.correlation_catalog(r.select(F.col("symbol").alias("series"), "d", F.col("var_pct").alias("value")), families=fam)


@query("F17_rolling_corr_rank", "symbol d:s corr:f rank:i",
       """SELECT symbol, d, c AS corr, row_number() OVER (PARTITION BY symbol ORDER BY c DESC, d) AS rank FROM (
          SELECT symbol, d, CASE WHEN count(*) OVER f >= 20 THEN corr(x, y) OVER f END AS c FROM (
            SELECT r.symbol, r.d, r.var_pct AS x, v.var_pct AS y FROM ret AS r JOIN vret AS v ON r.d = v.d
            QUALIFY r.d >= max(r.d) OVER (PARTITION BY r.symbol) - INTERVAL 7 MONTH) AS j
          WINDOW f AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS k WHERE c IS NOT NULL""", [*RET, VIX, VRET])
def f17(spark, sf):
    return A.rolling_corr_rank(ret(spark, sf), vret(spark, sf))


@query("F18_relation", "symbol n:i ret_corr:f level_corr:f share_a_above_pct:f ratio_mean:f ratio_p25:f ratio_p50:f ratio_p75:f spread_mean:f max_ratio_d:s min_ratio_d:s max_spread_d:s min_spread_d:s",
       """SELECT symbol, count(*) AS n, corr(ra, rb) AS ret_corr, corr(a, b) AS level_corr, avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END) * 100 AS share_a_above_pct, avg(a / b) AS ratio_mean,
          quantile_cont(a / b, 0.25) AS ratio_p25, quantile_cont(a / b, 0.5) AS ratio_p50, quantile_cont(a / b, 0.75) AS ratio_p75, avg(a - b) AS spread_mean,
          first(d ORDER BY a / b DESC, d) AS max_ratio_d, first(d ORDER BY a / b, d) AS min_ratio_d, first(d ORDER BY a - b DESC, d) AS max_spread_d, first(d ORDER BY a - b, d) AS min_spread_d
          FROM (SELECT r.symbol, r.d, r.close AS a, v.close AS b, r.var_pct AS ra, v.var_pct AS rb FROM ret AS r JOIN vret AS v ON r.d = v.d) AS j GROUP BY symbol""", [*RET, VIX, VRET])
def f18(spark, sf):
    return A.relation(ret(spark, sf), vret(spark, sf))


MODAL = """LEFT JOIN (SELECT symbol, bin, k FROM (SELECT symbol, bin, {k} AS k, row_number() OVER (PARTITION BY symbol, bin ORDER BY count(*) DESC, {k}) AS rn FROM bn GROUP BY symbol, bin, {k}) AS q WHERE rn = 1) AS {a}
          ON {a}.symbol = b.symbol AND {a}.bin = b.bin"""


@query("F19_return_distribution", "symbol bin_low:i n:i modal_month:i modal_dow:i",
       f"""SELECT b.symbol, b.bin AS bin_low, b.n, m.k AS modal_month, w.k AS modal_dow FROM (SELECT symbol, bin, count(*) AS n FROM bn GROUP BY symbol, bin) AS b
          {MODAL.format(k='month', a='m')} {MODAL.format(k='dow', a='w')}""", [*RET, "bn AS (SELECT *, CAST(floor(var_pct) AS BIGINT) AS bin FROM ret WHERE var_pct IS NOT NULL)"])
def f19(spark, sf):
    return A.return_distribution(ret(spark, sf))


@query("F20_iso_week_rank", "series iso_year:i iso_week:i mean_value:f9 min_value:f max_value:f n:i rank:i",
       """SELECT *, row_number() OVER (PARTITION BY series ORDER BY mean_value DESC, max_value DESC, iso_year, iso_week) AS rank FROM (
          SELECT series, isoyear(d) AS iso_year, week(d) AS iso_week, avg(value) AS mean_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM market GROUP BY 1, 2, 3) AS g""", [MARKET])
def f20(spark, sf):
    return A.iso_week_rank(market(spark, sf))


@query("F21_lowest_weekday_by_year", "series year:i weekday:i mean_value:f9 n:i",
       """SELECT series, year, weekday, mean_value, n FROM (SELECT series, year(d) AS year, isodow(d) - 1 AS weekday, avg(value) AS mean_value, count(*) AS n FROM market GROUP BY 1, 2, 3) AS g
          QUALIFY row_number() OVER (PARTITION BY series, year ORDER BY mean_value, weekday) = 1""", [MARKET])
def f21(spark, sf):
    return A.lowest_weekday_by_year(market(spark, sf))


@query("F22_month_hit_frequency", "symbol month_start:s n_hits:i is_latest:b",
       """SELECT *, month_start = max(month_start) OVER (PARTITION BY symbol) AS is_latest FROM (
          SELECT symbol, CAST(date_trunc('month', d) AS DATE) AS month_start, count(*) FILTER (WHERE var_pct > 100) AS n_hits FROM ret GROUP BY 1, 2) AS g WHERE n_hits >= 4""", RET)
def f22(spark, sf):
    return A.month_hit_frequency(ret(spark, sf), F.col("var_pct") > 100)


@query("F23_threshold_occurrence", "symbol first_d:s first_value:f last_d:s last_value:f n:i",
       "SELECT symbol, min(d) AS first_d, arg_min(close, d) AS first_value, max(d) AS last_d, arg_max(close, d) AS last_value, count(*) AS n FROM bars WHERE close >= 90000 GROUP BY symbol", [BARS])
def f23(spark, sf):
    return A.threshold_occurrence(bars(spark, sf), "close", ">=", 90000.0)


@query("F24_summarize", "symbol n:i mean:f median:f min:f max:f std:f",
       "SELECT symbol, count(var_pct) AS n, avg(var_pct) AS mean, median(var_pct) AS median, min(var_pct) AS min, max(var_pct) AS max, stddev_samp(var_pct) AS std FROM ret WHERE dow = 0 GROUP BY symbol", RET)
def f24(spark, sf):
    return A.summarize(ret(spark, sf), "var_pct", F.col("dow") == 0)


@query("F25_forward_summary", "symbol n:i mean:f positive_rate:f best:f worst:f n_directional:i ratio_directional:f",
       """SELECT symbol, count(*) AS n, avg(r) AS mean, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate, max(r) AS best, min(r) AS worst, count(*) FILTER (WHERE r < 0) AS n_directional,
          count(*) FILTER (WHERE r < 0) * 1.0 / count(*) AS ratio_directional FROM (
          SELECT f.*, m.value FROM (SELECT symbol, d, (lead(close, 5) OVER (PARTITION BY symbol ORDER BY d) - close) / close AS r FROM bars) AS f
          ASOF LEFT JOIN (SELECT d, value FROM market WHERE series = '1-URGENT') AS m ON f.d >= m.d) AS j WHERE value > 30 AND r IS NOT NULL GROUP BY symbol""", [BARS, MARKET])
def f25(spark, sf):
    level = market(spark, sf).filter("series = '1-URGENT'").select("d", "value")
    rows = J.asof_join(S.forward_return(bars(spark, sf), 5), level, on="d")
    return A.forward_summary(rows, F.col("value") > 30, rule="<0")


@query("F26_cross_asset_condition_mean", "symbol n:i mean:f n_up:i",
       """SELECT symbol, count(*) AS n, avg(var_pct) AS mean, count(*) FILTER (WHERE var_pct > 0) AS n_up FROM ret WHERE d IN (SELECT d FROM vix WHERE close >= 20)
          AND d IN (SELECT d FROM (SELECT d, close < open AND lag(close < open) OVER (ORDER BY d) AS hit FROM bars WHERE symbol = 'AF') AS a WHERE hit) GROUP BY symbol""", [*RET, VIX])
def f26(spark, sf):
    af = C.color_sequence(bars(spark, sf).filter("symbol = 'AF'"), ["red", "red"])
    return A.cross_asset_condition_mean(ret(spark, sf), [P.dates_where(vix(spark, sf), F.col("close") >= 20), P.dates_where(af, "sequence")], "var_pct")


@query("F27_composite_conditions", "symbol year:i n:i mean:f",
       """SELECT symbol, year, count(*) AS n, avg(var_pct) AS mean FROM ret WHERE d IN (SELECT d FROM vix WHERE close > 20) AND d IN (SELECT d FROM market WHERE series = '5-LOW' AND value < 30)
          AND dow IN (0) AND year IN (1996, 1997, 1998) GROUP BY symbol, year""", [*RET, VIX, MARKET])
def f27(spark, sf):
    low = P.dates_where(market(spark, sf), (F.col("series") == "5-LOW") & (F.col("value") < 30))
    rows = J.left_merge_conditions(ret(spark, sf), {"fear": high_vix(spark, sf, 20.0), "low_level": low})
    return A.composite_conditions(rows, ["fear", "low_level"], "var_pct", weekday=0, years=[1996, 1997, 1998], per_year=True)


@query("F28_boolean_condition_metric", "symbol n:i probability:f mean:f",
       """SELECT symbol, count(*) AS n, avg(CASE WHEN next_var > 0 THEN 1.0 ELSE 0.0 END) AS probability, avg(next_var) AS mean FROM ret
          WHERE (d IN (SELECT d FROM vix WHERE close > 35) OR d IN (SELECT d FROM vix WHERE close < 10)) AND NOT coalesce(var_pct > 50, false) GROUP BY symbol""", [*RET, VIX])
def f28(spark, sf):
    v = vix(spark, sf)
    rows = J.left_merge_conditions(ret(spark, sf), {"fear": P.dates_where(v, F.col("close") > 35), "calm": P.dates_where(v, F.col("close") < 10)})
    return A.boolean_condition_metric(rows, ("and", ("or", "fear", "calm"), ("not", F.col("var_pct") > 50)), "next_var")


@query("F29_neutral_next", "symbol rank:i d:s var_pct:f next_var:f n_total:i",
       """SELECT * FROM (SELECT symbol, d, var_pct, next_var, row_number() OVER (PARTITION BY symbol ORDER BY abs(next_var), d) AS rank, count(*) OVER (PARTITION BY symbol) AS n_total
          FROM ret WHERE var_pct <= -5 AND next_var IS NOT NULL) AS r""", RET)
def f29(spark, sf):
    return A.neutral_next(ret(spark, sf))


@query("F30_open_up_count", "symbol n_up:i total:i pct:f",
       """SELECT symbol, count(*) FILTER (WHERE up) AS n_up, count(*) AS total, count(*) FILTER (WHERE up) * 100.0 / count(*) AS pct FROM (
          SELECT b.symbol, v.close AS v, b.open > lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.d) AS up FROM bars AS b JOIN vix AS v ON b.d = v.d) AS j WHERE v > 25 GROUP BY symbol""", [BARS, VIX])
def f30(spark, sf):
    return A.open_up_count(bars(spark, sf), vix(spark, sf), 25.0)


@query("F31_amplitude_distribution", "symbol threshold:f n_sessions:i hl_median:f hl_mean:f co_median:f pct_hl_above:f pct_co_above:f",
       """SELECT symbol, t AS threshold, count(*) AS n_sessions, median(high - low) AS hl_median, avg(high - low) AS hl_mean, median(abs(close - open)) AS co_median,
          avg(CASE WHEN high - low >= t THEN 1.0 ELSE 0.0 END) * 100 AS pct_hl_above, avg(CASE WHEN abs(close - open) >= t THEN 1.0 ELSE 0.0 END) * 100 AS pct_co_above
          FROM (SELECT b.*, v.open AS lv FROM bars AS b ASOF JOIN vix AS v ON b.d >= v.d) AS j CROSS JOIN (SELECT unnest([1000.0, 20000.0, 60000.0]) AS t) AS x
          WHERE lv BETWEEN 15 AND 30 GROUP BY symbol, t""", [BARS, VIX])
def f31(spark, sf):
    return A.amplitude_distribution(bars(spark, sf), vix(spark, sf), 15.0, 30.0, (1000.0, 20000.0, 60000.0))
