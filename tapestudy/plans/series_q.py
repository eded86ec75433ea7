"""Queries of the base series columns (D)."""

from __future__ import annotations


from ..operators import series as S
from .inputs import BARS, VIX, bars, vix
from .registry import query

W = "WINDOW w AS (PARTITION BY symbol ORDER BY d)"

RETURNS = """ret AS (
  SELECT *, (close - prev_close) / nullif(prev_close, 0) * 100.0 AS var_pct,
         (next_close - close) / nullif(close, 0) * 100.0 AS next_var,
         isodow(d) - 1 AS dow, month(d) AS month, year(d) AS year
  FROM (SELECT *, lag(close) OVER w AS prev_close, lead(close) OVER w AS next_close
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS b)"""


def roll(stat, x, n, m=None):
    """SQL text of a rolling statistic with a minimum count."""
    f = f"OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {m if m is not None else n} THEN {stat}({x}) {f} END"


def pctchg(x, n=1, scale="100.0"):
    p = f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY d)"
    return f"({x} - {p}) / nullif({p}, 0) * {scale}"


@query("D1_returns", "symbol d:s prev_close:f var_pct:f next_close:f next_var:f dow:i month:i year:i",
       "SELECT * FROM ret", [BARS, RETURNS])
def d1(spark, sf):
    return S.returns(bars(spark, sf))


@query("D2_forward_closes", "symbol d:s close_j1:f close_j5:f low_j1:f low_j5:f var_j1:f var_j5:f",
       f"""SELECT symbol, d, lead(close, 1) OVER w AS close_j1, lead(close, 5) OVER w AS close_j5,
       lead(low, 1) OVER w AS low_j1, lead(low, 5) OVER w AS low_j5,
       (lead(close, 1) OVER w - close) / nullif(close, 0) * 100.0 AS var_j1,
       (lead(close, 5) OVER w - close) / nullif(close, 0) * 100.0 AS var_j5 FROM bars {W}""", [BARS])
def d2(spark, sf):
    return S.forward_closes(bars(spark, sf))


@query("D3_forward_return", "symbol d:s fwd21:f fwd1_5:f",
       f"""SELECT symbol, d, (lead(close, 21) OVER w - close) / nullif(close, 0) AS fwd21,
       (lead(close, 5) OVER w - lead(close, 1) OVER w) / nullif(lead(close, 1) OVER w, 0) AS fwd1_5 FROM bars {W}""", [BARS])
def d3(spark, sf):
    return S.forward_return(S.forward_return(bars(spark, sf), 21, name="fwd21"), (1, 5), name="fwd1_5")


@query("D4_gap", "symbol d:s gap_pct:f overnight_pct:f",
       f"""SELECT symbol, d, (open - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100.0 AS gap_pct,
       (lead(open) OVER w - close) / nullif(close, 0) * 100.0 AS overnight_pct FROM bars {W}""", [BARS])
def d4(spark, sf):
    return S.gap(bars(spark, sf))


@query("D5_open_close_return", "symbol d:s open_close_pct:f abs_open_close_pct:f range_pct:f",
       """SELECT symbol, d, (close - open) / open * 100.0 AS open_close_pct,
       abs((close - open) / open * 100.0) AS abs_open_close_pct, (high - low) / close * 100.0 AS range_pct FROM bars""", [BARS])
def d5(spark, sf):
    return S.bar_returns(bars(spark, sf))


@query("D6_volume_features", "symbol d:s vol_ma20:f vol_ratio:f vol_up3:i",
       f"""SELECT symbol, d, vol_ma20, volume / vol_ma20 AS vol_ratio, {roll('sum', 'rise', 3)} AS vol_up3
       FROM (SELECT *, {roll('avg', 'volume', 20)} AS vol_ma20,
             CASE WHEN volume > lag(volume) OVER w THEN 1 ELSE 0 END AS rise FROM bars {W}) AS b""", [BARS])
def d6(spark, sf):
    return S.volume_features(bars(spark, sf))


@query("D7_rolling_stat", "symbol d:s mean20:f std20:f min10:f max10:f sum5:f",
       f"""SELECT symbol, d, {roll('avg', 'close', 20)} AS mean20, {roll('stddev_samp', 'close', 20, 10)} AS std20,
       {roll('min', 'close', 10, 3)} AS min10, {roll('max', 'close', 10, 5)} AS max10, {roll('sum', 'close', 5)} AS sum5 FROM bars""", [BARS])
def d7(spark, sf):
    df = S.rolling_stat(bars(spark, sf), "close", 20)
    df = S.rolling_stat(df, "close", 20, "std", 10)
    df = S.rolling_stat(df, "close", 10, "min", 3)
    df = S.rolling_stat(df, "close", 10, "max", 5)
    return S.rolling_stat(df, "close", 5, "sum")


def z_sql(x, n, m=None):
    return f"({x} - {roll('avg', x, n, m)}) / nullif({roll('stddev_samp', x, n, m)}, 0)"


@query("D8_zscore", "symbol d:s z20:f z60:f",
       f"SELECT symbol, d, {z_sql('close', 20, 10)} AS z20, {z_sql('close', 60, 30)} AS z60 FROM bars", [BARS])
def d8(spark, sf):
    return S.zscore(S.zscore(bars(spark, sf), "close", 20, 10), "close", 60, 30)


@query("D9_rolling_quantile", "symbol d:s q80_60:f q50_20:f",
       """SELECT symbol, d, CASE WHEN count(close) OVER f60 >= 60 THEN quantile_cont(close, 0.8) OVER f60 END AS q80_60,
       CASE WHEN count(close) OVER f20 >= 20 THEN quantile_cont(close, 0.5) OVER f20 END AS q50_20 FROM bars
       WINDOW f60 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
              f20 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", [BARS])
def d9(spark, sf):
    return S.rolling_quantile(S.rolling_quantile(bars(spark, sf), "close", 60, 0.8), "close", 20, 0.5)


@query("D10_rolling_pct_rank", "symbol d:s pct252:f",
       """SELECT symbol, d, CASE WHEN len(seen) >= 60 THEN
       (len(list_filter(seen, lambda x: x < volume)) + (len(list_filter(seen, lambda x: x = volume)) + 1) / 2.0) / len(seen) * 100.0 END AS pct252
       FROM (SELECT symbol, d, volume, list(volume) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS seen FROM bars) AS b""", [BARS])
def d10(spark, sf):
    return S.rolling_pct_rank(bars(spark, sf), "volume")


@query("D11_rolling_corr", "symbol d:s corr20:f",
       """SELECT symbol, d, CASE WHEN count(*) OVER f >= 20 THEN corr(close, volume) OVER f END AS corr20 FROM bars
       WINDOW f AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", [BARS])
def d11(spark, sf):
    return S.rolling_corr(bars(spark, sf), "close", "volume", 20)


@query("D12_momentum", "symbol d:s mom1:f mom5:f mom20:f accel5:f diff3:f",
       f"""SELECT symbol, d, mom1, mom5, mom20, mom5 - lag(mom5, 5) OVER w AS accel5, diff3
       FROM (SELECT symbol, d, {pctchg('close')} AS mom1, {pctchg('close', 5)} AS mom5, {pctchg('close', 20)} AS mom20,
             close - lag(close, 3) OVER (PARTITION BY symbol ORDER BY d) AS diff3 FROM bars) AS b {W}""", [BARS])
def d12(spark, sf):
    return S.momentum(bars(spark, sf))


@query("D13_lags", "symbol d:s lag2:f lag10:f diff_1_3:f diff_5_10:f",
       f"""SELECT symbol, d, lag(close, 2) OVER w AS lag2, lag(close, 10) OVER w AS lag10,
       lag(close, 1) OVER w - lag(close, 3) OVER w AS diff_1_3, lag(close, 5) OVER w - lag(close, 10) OVER w AS diff_5_10 FROM bars {W}""", [BARS])
def d13(spark, sf):
    return S.lags(bars(spark, sf))


@query("D14_crosses", "symbol d:s cross_ma20_up:i cross_ma20_down:i cross_20_up:i cross_20_down:i breakout_up10:i breakout_down10:i",
       f"""SELECT symbol, d, CAST(above AND NOT coalesce(lag(above) OVER w, false) AS INT) AS cross_ma20_up,
       CAST(NOT above AND coalesce(lag(above) OVER w, false) AS INT) AS cross_ma20_down,
       CASE WHEN close >= 20 AND lag(close) OVER w < 20 THEN 1 ELSE 0 END AS cross_20_up,
       CASE WHEN close < 20 AND lag(close) OVER w >= 20 THEN 1 ELSE 0 END AS cross_20_down,
       CASE WHEN close >= hi THEN 1 ELSE 0 END AS breakout_up10, CASE WHEN close <= lo THEN 1 ELSE 0 END AS breakout_down10
       FROM (SELECT *, coalesce(close > {roll('avg', 'close', 20, 10)}, false) AS above, {roll('max', 'close', 10, 5)} AS hi,
             {roll('min', 'close', 10, 5)} AS lo FROM vix) AS b {W}""", [VIX])
def d14(spark, sf):
    return S.breakout(S.level_cross(S.ma_cross(vix(spark, sf)), level=20.0))


@query("D15_drawdown", "symbol d:s dist_high_pct:f dist_low_pct:f dd_5:i dd_10:i recovering:i",
       f"""SELECT symbol, d, dist_high_pct, dist_low_pct, CASE WHEN dist_high_pct < -5 THEN 1 ELSE 0 END AS dd_5,
       CASE WHEN dist_high_pct < -10 THEN 1 ELSE 0 END AS dd_10,
       CASE WHEN dist_high_pct > lag(dist_high_pct, 5) OVER w AND dist_high_pct < -3 THEN 1 ELSE 0 END AS recovering
       FROM (SELECT symbol, d, (close - hi) / nullif(hi, 0) * 100.0 AS dist_high_pct, (close - lo) / nullif(lo, 0) * 100.0 AS dist_low_pct
             FROM (SELECT *, {roll('max', 'close', 252, 60)} AS hi, {roll('min', 'close', 252, 60)} AS lo FROM bars) AS a) AS b {W}""", [BARS])
def d15(spark, sf):
    return S.drawdown(bars(spark, sf))


@query("D16_streak", "symbol d:s consec_up:i consec_dn:i streak:i",
       """SELECT symbol, d, CASE WHEN up THEN row_number() OVER (PARTITION BY symbol, up_run ORDER BY d) ELSE 0 END AS consec_up,
       CASE WHEN dn THEN row_number() OVER (PARTITION BY symbol, dn_run ORDER BY d) ELSE 0 END AS consec_dn,
       row_number() OVER (PARTITION BY symbol, up_run ORDER BY d) * CASE WHEN up THEN 1 ELSE -1 END AS streak
       FROM (SELECT *, sum(CASE WHEN up IS DISTINCT FROM pu THEN 1 ELSE 0 END) OVER w AS up_run,
                    sum(CASE WHEN dn IS DISTINCT FROM pd THEN 1 ELSE 0 END) OVER w AS dn_run
             FROM (SELECT *, lag(up) OVER w AS pu, lag(dn) OVER w AS pd
                   FROM (SELECT symbol, d, coalesce(var_pct > 0, false) AS up, coalesce(var_pct < 0, false) AS dn FROM ret) AS r0
                   WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS r1
             WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS r2""", [BARS, RETURNS])
def d16(spark, sf):
    return S.streak(S.returns(bars(spark, sf)))


@query("D17_atr", "symbol d:s true_range_pct:f atr5:f atr14:f",
       f"""SELECT symbol, d, tr / prev * 100.0 AS true_range_pct, {roll('avg', 'tr', 5, 2)} / prev * 100.0 AS atr5,
       {roll('avg', 'tr', 14, 7)} / prev * 100.0 AS atr14
       FROM (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr
             FROM (SELECT *, lag(close) OVER w AS prev FROM bars {W}) AS a) AS b""", [BARS])
def d17(spark, sf):
    return S.atr(bars(spark, sf))


@query("D18_candle_geometry", "symbol d:s body_pct:f direction:i upper_shadow_pct:f lower_shadow_pct:f close_position:f body_ratio:f doji:i effort:f4",
       """SELECT symbol, d, abs(close - open) / open * 100.0 AS body_pct, sign(close - open) AS direction,
       greatest((high - greatest(open, close)) / high * 100.0, 0) AS upper_shadow_pct,
       greatest((least(open, close) - low) / least(open, close) * 100.0, 0) AS lower_shadow_pct,
       (close - low) / nullif(high - low, 0) AS close_position, abs(close - open) / nullif(high - low, 0) AS body_ratio,
       CASE WHEN abs(close - open) / nullif(high - low, 0) < 0.1 THEN 1 ELSE 0 END AS doji,
       nullif(high - low, 0) * volume / 1e6 AS effort FROM bars""", [BARS])
def d18(spark, sf):
    return S.candle_geometry(bars(spark, sf))


@query("D19_realized_vol", "symbol d:s vol5:f vol10:f vol20:f",
       f"""SELECT symbol, d, {roll('stddev_samp', 'r', 5, 2)} AS vol5, {roll('stddev_samp', 'r', 10, 5)} AS vol10,
       {roll('stddev_samp', 'r', 20, 10)} AS vol20 FROM (SELECT symbol, d, {pctchg('close')} AS r FROM bars) AS b""", [BARS])
def d19(spark, sf):
    return S.realized_vol(bars(spark, sf))


@query("D20_ex_ante_returns", "symbol d:s ret_1w:f ret_2w:f ret_4w:f std5_prev:f",
       f"""SELECT symbol, d, c1 / c6 - 1 AS ret_1w, c1 / c11 - 1 AS ret_2w, c1 / c21 - 1 AS ret_4w, lag(s) OVER w AS std5_prev
       FROM (SELECT symbol, d, c1, c6, c11, c21, {roll('stddev_samp', 'r', 5)} AS s
             FROM (SELECT symbol, d, lag(close, 1) OVER w AS c1, lag(close, 6) OVER w AS c6, lag(close, 11) OVER w AS c11,
                          lag(close, 21) OVER w AS c21, {pctchg('close', 1, '1.0')} AS r FROM bars {W}) AS a) AS b {W}""", [BARS])
def d20(spark, sf):
    return S.ex_ante_returns(bars(spark, sf))


@query("D21_pair_feature", "symbol d:s derived:f change_1d:f derived_z:f",
       f"""SELECT symbol, d, derived, {pctchg('derived', 1, '1.0')} AS change_1d, {z_sql('derived', 20)} AS derived_z
       FROM (SELECT a.symbol, a.d, a.close / v.close AS derived FROM bars AS a JOIN vix AS v ON a.d = v.d
             QUALIFY a.d >= max(a.d) OVER (PARTITION BY a.symbol) - 1461) AS j""", [BARS, VIX])
def d21(spark, sf):
    return S.pair_feature(bars(spark, sf), vix(spark, sf), "ratio", years=4)
