"""Queries of calendar and feature families (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as H
from .inputs import ASSETS, BARS, CALENDAR, MARKET, ROLES, VIX, assets, bars, calendar, vix
from .registry import query

KEY_WORDS = {k: "(" + " OR ".join(f"lower(event) LIKE '%{w.lower()}%'" for w in words) + ")" for k, words in H.KEY_EVENTS.items()}
ANY_KEY = "(" + " OR ".join(KEY_WORDS.values()) + ")"
CALDAYS = f"""caldays AS (SELECT d, count(opex) > 0 AS is_opex, count(*) FILTER (WHERE impact = 'high') > 0 AS is_high_impact, count(*) FILTER (WHERE impact = 'high') AS n_high_events,
  count(*) FILTER (WHERE impact = 'medium') AS n_medium_events, count(earnings_top2) > 0 AS is_earnings_top2, count(low_activity) > 0 AS is_low_activity,
  {", ".join(f"bool_or(impact = 'high' AND {w}) AS is_{k}" for k, w in KEY_WORDS.items())},
  sum(actual - estimate) FILTER (WHERE impact = 'high' AND {ANY_KEY}) AS macro_surprise_raw FROM calendar GROUP BY d)"""


def caldays(spark, sf):
    return H.calendar_features(calendar(spark, sf)).withColumn("panel", F.lit("us"))


@query("H1_calendar_features", "d:s is_opex:b is_high_impact:b n_high_events:i n_medium_events:i is_earnings_top2:b is_low_activity:b is_cpi:b is_pce:b is_nfp:b macro_surprise_raw:f9",
       "SELECT * FROM caldays", [CALENDAR, CALDAYS])
def h1(spark, sf):
    return caldays(spark, sf)


@query("H1_calendar_day_flags", "d:s is_macro_day:b is_quiet_day:b is_high_impact_day:b has_macro_time:b",
       "SELECT d, true AS is_macro_day, count(low_activity) > 0 AS is_quiet_day, bool_or(impact = 'high') AS is_high_impact_day, false AS has_macro_time FROM calendar GROUP BY d", [CALENDAR])
def h1_flags(spark, sf):
    return H.calendar_day_flags(calendar(spark, sf))


def win(n):
    return f"OVER (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rs(stat, x, n, m=None):
    return f"CASE WHEN count({x}) {win(n)} >= {n if m is None else m} THEN {stat}({x}) {win(n)} END"


def z(x, n, m=None):
    return f"(({x} - {rs('avg', x, n, m)}) / nullif({rs('stddev_samp', x, n, m)}, 0))"


def mom(x, n=1):
    return f"(({x} - lag({x}, {n}) OVER (ORDER BY d)) / nullif(lag({x}, {n}) OVER (ORDER BY d), 0) * 100.0)"


def lg(x, n=1):
    return f"lag({x}, {n}) OVER (ORDER BY d)"


def qt(x, n, q, m=None):
    return f"CASE WHEN count({x}) {win(n)} >= {n if m is None else m} THEN quantile_cont({x}, {q}) {win(n)} END"


def fl(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def rcorr(a, b, n):
    return f"CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) {win(n)} >= {n} THEN corr({a}, {b}) {win(n)} END"


@query("H2_macro_surprise", "d:s macro_surprise:f", f"SELECT d, {z('macro_surprise_raw', 60, 5)} AS macro_surprise FROM caldays", [CALENDAR, CALDAYS])
def h2(spark, sf):
    return H.macro_surprise(caldays(spark, sf))


@query("H3_days_to_since", "d:s days_to_opex:i days_since_opex:i",
       """SELECT d, min(CASE WHEN is_opex THEN d END) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - d AS days_to_opex,
          d - max(CASE WHEN is_opex THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_opex FROM caldays""", [CALENDAR, CALDAYS])
def h3(spark, sf):
    return H.days_to_since(caldays(spark, sf), "is_opex", "opex")


LAGS = ", ".join(f"lag(value, {n}) OVER w AS {'v' if n == 1 else f'lag{n}'}" for n in (1, 2, 3, 4, 5, 10))
FILLED = f"""lagg AS (SELECT series, d, {LAGS} FROM assets WINDOW w AS (PARTITION BY series ORDER BY d)),
filled AS (SELECT i.d, l.series, l.v, l.lag2, l.lag3, l.lag4, l.lag5, l.lag10 FROM (SELECT DISTINCT d FROM bars) AS i CROSS JOIN (SELECT DISTINCT series FROM assets) AS s
  ASOF JOIN lagg AS l ON s.series = l.series AND i.d >= l.d)"""
PANEL = "panel AS (SELECT d, " + ", ".join(f"max(v) FILTER (WHERE series = '{r}') AS {r}" for r in ROLES) + " FROM filled GROUP BY d)"
LONG = [BARS, MARKET, ASSETS, FILLED]
ORDER_DAYS = [BARS, MARKET, VIX, ASSETS, FILLED.replace("FROM bars", "FROM vix")]
WIDE = [*LONG, PANEL]


def index(spark, sf):
    return bars(spark, sf).select("d").distinct()


def panel(spark, sf, roles=ROLES):
    return H.panel(assets(spark, sf), roles, index(spark, sf))


@query("H4_raw_lagged_features", "feature d:s value:f", "SELECT series AS feature, d, v AS value FROM (SELECT *, count(v) OVER (PARTITION BY series) AS n FROM filled) AS f WHERE n >= 30", LONG)
def h4(spark, sf):
    return H.raw_lagged_features(assets(spark, sf), index(spark, sf))


def per_series(text):
    return text.replace("OVER (ORDER BY", "OVER (PARTITION BY series ORDER BY")


H5 = {"mom5d": mom("v", 5), "mom20d": mom("v", 20), "z20": z("v", 20, 10), "distma50": f"(v - {rs('avg', 'v', 50, 25)}) / nullif({rs('avg', 'v', 50, 25)}, 0) * 100.0",
      "accel5": f"m5 - {lg('m5', 5)}", "vol10": rs("stddev_samp", "m1", 10, 5)}


def known(features):
    return features.filter(F.col("value").isNotNull())


@query("H5_derived_features", "feature d:s value:f",
       per_series("SELECT feature, d, value FROM (" + " UNION ALL ".join(
           f"SELECT series || '_{k}' AS feature, d, {e} AS value FROM (SELECT *, {mom('v')} AS m1, {mom('v', 5)} AS m5 FROM filled) AS f" for k, e in H5.items()) + ") AS u WHERE value IS NOT NULL"), LONG)
def h5(spark, sf):
    out = H.derived_features(assets(spark, sf), index(spark, sf))
    return known(out.filter(F.col("feature").rlike("_(" + "|".join(H5) + ")$")))


@query("H5_pct_rank", "feature d:s value:f",
       """SELECT series || '_pct252' AS feature, d, CASE WHEN v IS NOT NULL AND len(seen) >= 60 THEN
          (len(list_filter(seen, lambda x: x < v)) + (len(list_filter(seen, lambda x: x = v)) + 1) / 2.0) / len(seen) * 100.0 END AS value
          FROM (SELECT *, list(v) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS seen FROM filled) AS f""", LONG)
def h5_rank(spark, sf):
    return H.derived_features(assets(spark, sf), index(spark, sf)).filter(F.col("feature").endswith("_pct252"))


@query("H6_cross_features", "d:s ratio_vix_vix3m:f ratio_vix_vix3m_z20:f ratio_dxy_gold_z20:f spread_vix3m_vix:f spread_vix3m_vix_z20:f interact_vix_skew_z20:f corr_spx_gold_10d:f corr_vix_spx_20d:f spx_vs_iwm_5d:f",
       f"""SELECT d, r1 AS ratio_vix_vix3m, {z('r1', 20)} AS ratio_vix_vix3m_z20, {z('r2', 20)} AS ratio_dxy_gold_z20, s1 AS spread_vix3m_vix, {z('s1', 20)} AS spread_vix3m_vix_z20, {z('x1', 20)} AS interact_vix_skew_z20,
          {rcorr('m_spx', 'm_gold', 10)} AS corr_spx_gold_10d, {rcorr('m_vix', 'm_spx', 20)} AS corr_vix_spx_20d, {mom('spx', 5)} - {mom('iwm', 5)} AS spx_vs_iwm_5d
          FROM (SELECT *, vix / nullif(vix3m, 0) AS r1, dxy / nullif(gold, 0) AS r2, vix3m - vix AS s1, vix * skew AS x1, {mom('spx')} AS m_spx, {mom('gold')} AS m_gold, {mom('vix')} AS m_vix FROM panel) AS p""", WIDE)
def h6(spark, sf):
    return H.cross_features(panel(spark, sf))


@query("H7_temporal_features", "d:s day_of_week:i week_of_year:i is_month_end:i spx_above_ma20:i spx_dist_ma60_pct:f spx_streak:i spx_rvol_20d:f vix_regime_normal:i vix_regime_crisis:i vix_mom5d:f vix_spike:i vix_crush:i",
       f"""SELECT d, isodow(d) - 1 AS day_of_week, week(d) AS week_of_year, {fl('day(d) >= 25')} AS is_month_end, {fl(f"spx > {rs('avg', 'spx', 20, 10)}")} AS spx_above_ma20,
          (spx - {rs('avg', 'spx', 60, 30)}) / nullif({rs('avg', 'spx', 60, 30)}, 0) * 100.0 AS spx_dist_ma60_pct, row_number() OVER (PARTITION BY up, run ORDER BY d) * CASE WHEN up THEN 1 ELSE -1 END AS spx_streak,
          {rs('stddev_samp', 'r', 20, 10)} * 100.0 AS spx_rvol_20d, {fl('vix >= 15 AND vix < 20')} AS vix_regime_normal, {fl('vix >= 30')} AS vix_regime_crisis, {mom('vix', 5)} AS vix_mom5d,
          {fl(f"vix > {lg('vix')} * 1.10")} AS vix_spike, {fl(f"vix < {lg('vix')} * 0.90")} AS vix_crush
          FROM (SELECT *, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY up ORDER BY d) AS run
                FROM (SELECT *, coalesce(r > 0, false) AS up FROM (SELECT *, {mom('spx')} / 100.0 AS r FROM panel) AS a) AS b) AS p""", WIDE)
def h7(spark, sf):
    return H.temporal_features(panel(spark, sf, ["spx", "vix"]))


H8 = {"lag2": "lag2", "lag10": "lag10", "diff_3_10": "lag3 - lag10", "streak_bull2": fl(f"{rs('sum', 'up', 2)} = 2"), "streak_bear3": fl(f"{rs('sum', 'up', 3)} = 0"),
      "cross_ma20_up": fl(f"a20 AND NOT coalesce({lg('a20')}, false)"), "cross_ma5_down": fl(f"NOT a5 AND coalesce({lg('a5')}, false)"),
      "breakout_up10": fl(f"v >= {rs('max', 'v', 10, 5)}"), "breakout_down20": fl(f"v <= {rs('min', 'v', 20, 10)}")}


@query("H8_lag_features", "feature d:s value:f",
       per_series("SELECT feature, d, value FROM (" + " UNION ALL ".join(
           f"SELECT series || '_{k}' AS feature, d, CAST({e} AS DOUBLE) AS value FROM (SELECT *, {fl(f'{mom(chr(118))} > 0')} AS up, coalesce(v > {rs('avg', 'v', 5, 3)}, false) AS a5, coalesce(v > {rs('avg', 'v', 20, 10)}, false) AS a20 FROM filled) AS f"
           for k, e in H8.items()) + ") AS u WHERE value IS NOT NULL"), ORDER_DAYS)
def h8(spark, sf):
    out = H.lag_features(assets(spark, sf), vix(spark, sf).select("d"))
    return known(out.filter(F.col("feature").rlike("_(" + "|".join(H8) + ")$")))


@query("H8_lag_interactions", "d:s vix_j1_x_spx_m5:f vix_up3_and_spx_dn3:i skew_j1_x_vix_m3:f",
       f"SELECT d, vix * {mom('spx', 5)} AS vix_j1_x_spx_m5, {fl(f'''vix > {lg('vix', 3)}''')} * {fl(f'''spx < {lg('spx', 3)}''')} AS vix_up3_and_spx_dn3, skew * {mom('vix', 3)} AS skew_j1_x_vix_m3 FROM panel", WIDE)
def h8_interactions(spark, sf):
    return H.lag_interactions(panel(spark, sf, ["spx", "vix", "skew"]))


def per_symbol(text):
    return text.replace("OVER (ORDER BY", "OVER (PARTITION BY symbol ORDER BY")


@query("H9_microstructure_features", "symbol d:s body_pct:f body_dir:i upper_shadow:f close_position:f gap_pct:f gap_up:i true_range:f atr14:f is_doji:i effort_result:f4 bull_candles2:i bear_candles3:i",
       per_symbol(f"""SELECT symbol, d, abs(c - o) / o * 100.0 AS body_pct, sign(c - o) AS body_dir, greatest((h - greatest(o, c)) / h * 100.0, 0) AS upper_shadow, (c - l) / nullif(h - l, 0) AS close_position, (o - p) / p * 100.0 AS gap_pct,
          {fl('(o - p) / p * 100.0 > 0.1')} AS gap_up, tr / p * 100.0 AS true_range, {rs('avg', 'tr', 14, 7)} / p * 100.0 AS atr14, {fl('abs(c - o) / nullif(h - l, 0) < 0.1')} AS is_doji, nullif(h - l, 0) * vol / 1e6 AS effort_result,
          {fl(f"{rs('sum', 'bull', 2)} = 2")} AS bull_candles2, {fl(f"{rs('sum', 'bear', 3)} = 3")} AS bear_candles3
          FROM (SELECT *, CASE WHEN h IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) END AS tr, {fl('c > o')} AS bull, {fl('c < o')} AS bear FROM (
            SELECT i.d, b.* EXCLUDE (d) FROM (SELECT DISTINCT d FROM vix) AS i CROSS JOIN (SELECT DISTINCT symbol AS s FROM bars) AS s
            ASOF JOIN (SELECT symbol, d, lag(open) OVER w AS o, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS c, lag(volume) OVER w AS vol, lag(close, 2) OVER w AS p FROM bars
                       WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS b ON s.s = b.symbol AND i.d >= b.d) AS a) AS m"""), [BARS, VIX])
def h9(spark, sf):
    return H.microstructure_features(bars(spark, sf), vix(spark, sf).select("d"))


@query("H10_regime_transitions", "d:s vix_zscore_20:f spx_dist_ath_pct:f vix_cross_above_20:i vix_cross_below_15:i vix_compression:i vix_extreme_high:i spx_in_drawdown_5pct:i spx_recovering:i spx_strong_bear_20d:i vix_ts_inverted:i vix_ts_inversion_new:i vix_ts_spread_accel:f vvix_cross_above_ma20:i vvix_spike_3d:i skew_above_130:i skew_cross_130_up:i ad_cross_ma10_down:i ad_strong_bull_5d:i",
       f"""SELECT d, {z('vix', 20)} AS vix_zscore_20, ath AS spx_dist_ath_pct, {fl(f"vix >= 20 AND {lg('vix')} < 20")} AS vix_cross_above_20, {fl(f"vix < 15 AND {lg('vix')} >= 15")} AS vix_cross_below_15,
          {fl(f"{rs('stddev_samp', 'vix', 5)} < {rs('stddev_samp', 'vix', 20)} * 0.5")} AS vix_compression, {fl(f"{z('vix', 20)} > 2.0")} AS vix_extreme_high, {fl('ath < -5')} AS spx_in_drawdown_5pct,
          {fl(f"ath > {lg('ath', 5)} AND ath < -3")} AS spx_recovering, {fl(f"{mom('spx', 20)} < -5.0")} AS spx_strong_bear_20d, {fl('sp > 0')} AS vix_ts_inverted, {fl(f"sp > 0 AND {lg('sp')} <= 0")} AS vix_ts_inversion_new,
          sp - {lg('sp', 3)} AS vix_ts_spread_accel, {fl(f"vvix > vma AND {lg('vvix')} <= {lg('vma')}")} AS vvix_cross_above_ma20, {fl(f"vvix > vma + 2 * {rs('stddev_samp', 'vvix', 20)}")} AS vvix_spike_3d, {fl('skew > 130')} AS skew_above_130,
          {fl(f"skew > 130 AND {lg('skew')} <= 130")} AS skew_cross_130_up, {fl(f"ad < ama AND {lg('ad')} >= {lg('ama')}")} AS ad_cross_ma10_down, {fl(f"{mom('ad', 5)} > 5")} AS ad_strong_bull_5d
          FROM (SELECT *, vix9d - vix AS sp, (spx - {rs('max', 'spx', 252, 60)}) / nullif({rs('max', 'spx', 252, 60)}, 0) * 100.0 AS ath, {rs('avg', 'vvix', 20)} AS vma, {rs('avg', 'ad', 10)} AS ama FROM panel) AS p""", WIDE)
def h10(spark, sf):
    return H.regime_transitions(panel(spark, sf))


FIVE = ["spx_pc", "vix_pc", "equity_pc", "iwm_pc", "qqq_pc"]
MEAN5 = "list_avg([" + ", ".join(f"z_{a}" for a in FIVE) + "])"


@query("H11_put_call_sentiment", "d:s spx_pc_extreme_fear:i vix_pc_extreme_greed:i spx_pc_mom5d:f iwm_pc_z20:f qqq_pc_trending_fear:i spx_vs_equity_pc_ratio:f9 spx_vs_equity_pc_z20:f vix_vs_spx_pc_ratio:f9 composite_fear_index:f composite_greed_extreme:i",
       f"""SELECT d, {fl(f"spx_pc > {qt('spx_pc', 252, 0.9, 60)}")} AS spx_pc_extreme_fear, {fl(f"vix_pc < {qt('vix_pc', 252, 0.1, 60)}")} AS vix_pc_extreme_greed, {mom('spx_pc', 5)} AS spx_pc_mom5d, {z('iwm_pc', 20)} AS iwm_pc_z20,
          {fl(f"qqq_pc > {rs('avg', 'qqq_pc', 5)}")} AS qqq_pc_trending_fear, r AS spx_vs_equity_pc_ratio, {z('r', 20)} AS spx_vs_equity_pc_z20, vix_pc / nullif(spx_pc, 0) AS vix_vs_spx_pc_ratio, {MEAN5} AS composite_fear_index,
          {fl(f"{MEAN5} < -1.5")} AS composite_greed_extreme FROM (SELECT *, spx_pc / nullif(equity_pc, 0) AS r, {", ".join(f"{z(a, 60)} AS z_{a}" for a in FIVE)} FROM panel) AS p""", WIDE)
def h11(spark, sf):
    return H.put_call_sentiment(panel(spark, sf, FIVE))


MOMS = "pm AS (SELECT *, " + ", ".join(f"{mom(a)} AS m_{a}" for a in ("spx", "nikkei", "dax", "gold", "dxy", "bonds10", "iwm", "qqq", "vix")) + f""", bonds30 - bonds10 AS slope, {mom('spx', 5)} AS m5_spx, {mom('iwm', 5)} AS m5_iwm, {mom('qqq', 3)} AS m3_qqq,
  {mom('spx', 3)} AS m3_spx, {mom('gold', 5)} AS m5_gold, {mom('spx', 20)} AS m20_spx, {mom('vix', 5)} AS m5_vix FROM panel)"""
RISK = "(" + " + ".join(fl(c) for c in ("m_spx > 0", "m_gold < 0", "m_dxy < 0", "m_bonds10 > 0")) + ") / 4.0"


@query("H12_intermarket", "d:s gold_dist_ath:f nikkei_vs_spx_diverge:f gold_safe_haven:i risk_on_composite:f risk_on_strong:i small_vs_large_rotation:f bonds_up_spx_down:i spx_gold_corr_10d:f spx_gold_anticorr_5d:i spx_dxy_corr_20d:f dxy_above_ma20:i gold_near_ath:i yield_curve_proxy:f yield_curve_steepening:i",
       f"""SELECT d, (gold - {rs('max', 'gold', 252, 60)}) / nullif({rs('max', 'gold', 252, 60)}, 0) * 100.0 AS gold_dist_ath, m_nikkei - m_spx AS nikkei_vs_spx_diverge, {fl('m_gold > 1.0')} AS gold_safe_haven, {RISK} AS risk_on_composite,
          {fl(f"{RISK} > 0.75")} AS risk_on_strong, m_iwm - m_qqq AS small_vs_large_rotation, {fl('m_bonds10 > 0 AND m_spx < 0')} AS bonds_up_spx_down, {rcorr('m_spx', 'm_gold', 10)} AS spx_gold_corr_10d,
          {fl(f"{rcorr('m_spx', 'm_gold', 5)} < -0.5")} AS spx_gold_anticorr_5d, {rcorr('m_spx', 'm_dxy', 20)} AS spx_dxy_corr_20d, {fl(f"dxy > {rs('avg', 'dxy', 20)}")} AS dxy_above_ma20,
          {fl(f"(gold - {rs('max', 'gold', 252, 60)}) / nullif({rs('max', 'gold', 252, 60)}, 0) * 100.0 > -3")} AS gold_near_ath, slope AS yield_curve_proxy, {fl(f"{mom('slope', 5)} > 2")} AS yield_curve_steepening FROM pm""", [*WIDE, MOMS])
def h12(spark, sf):
    return H.intermarket(panel(spark, sf))


def sr(a, b):
    return f"{a} / CASE WHEN abs({b}) > 0.01 THEN {b} END"


STRESS = "list_avg([z1, z2, z3, z4])"


@query("H13_vol_term_structure", "d:s vts_vix9d_vix_ratio:f vts_vix9d_vix_spread:f vts_vix9d_vix_ratio_z60:f vts_vix9d_vix_spread_accel3:f vts_vix9d_vix_inverted:i vts_vix9d_vix_inversion_new:i vts_vix3m_vix6m_ratio_z20:f vts_vvix_vix_ratio_z20:f vts_vvix_high:i vts_skew_high_vix_low:i vts_skew_down_vix_up:i vts_composite_stress:f vts_composite_stress_low:i",
       f"""SELECT d, r1 AS vts_vix9d_vix_ratio, s1 AS vts_vix9d_vix_spread, {z('r1', 60, 30)} AS vts_vix9d_vix_ratio_z60, s1 - {lg('s1', 3)} AS vts_vix9d_vix_spread_accel3, i1 AS vts_vix9d_vix_inverted,
          {fl(f"i1 = 1 AND {lg('i1')} = 0")} AS vts_vix9d_vix_inversion_new, {z('r2', 20, 10)} AS vts_vix3m_vix6m_ratio_z20, {z('r3', 20, 10)} AS vts_vvix_vix_ratio_z20,
          {fl(f"vvix > {rs('avg', 'vvix', 20)} + 1.5 * {rs('stddev_samp', 'vvix', 20)}")} AS vts_vvix_high, {fl('skew > 130 AND vix < 18')} AS vts_skew_high_vix_low, {fl(f"{mom('skew', 3)} < -3 AND {mom('vix', 3)} > 5")} AS vts_skew_down_vix_up,
          {STRESS} AS vts_composite_stress, {fl(f"{STRESS} < -1.0")} AS vts_composite_stress_low
          FROM (SELECT *, {fl('r1 > 1')} AS i1, {z('vix', 20, 10)} AS z1, {z('s1', 20, 10)} AS z2, {z('vvix', 20, 10)} AS z3, {z('skew', 60, 30)} AS z4
                FROM (SELECT *, {sr('vix9d', 'vix')} AS r1, vix9d - vix AS s1, {sr('vix3m', 'vix6m')} AS r2, {sr('vvix', 'vix')} AS r3 FROM panel) AS a) AS p""", WIDE)
def h13(spark, sf):
    return H.vol_term_structure(panel(spark, sf))


@query("H14_momentum_divergence", "d:s div_spx_iwm_5d:f div_spx_iwm_5d_z20:f div_qqq_spx_3d:f div_spx_gold_5d:f div_spx_bonds10_corr10d:f div_spx_up_iwm_down_1d:i div_iwm_leads_spx_5d:i div_nikkei_crash:i div_gold_up_spx_down_5d:i div_triple_all_down:i div_triple_dispersion:f div_triple_high_dispersion:i",
       f"""SELECT d, d5 AS div_spx_iwm_5d, {z('d5', 20, 10)} AS div_spx_iwm_5d_z20, m3_qqq - m3_spx AS div_qqq_spx_3d, m5_spx - m5_gold AS div_spx_gold_5d, {rcorr('m_spx', 'm_bonds10', 10)} AS div_spx_bonds10_corr10d,
          {fl('m_spx > 0.5 AND m_iwm < -0.5')} AS div_spx_up_iwm_down_1d, {fl('m5_iwm > m5_spx + 0.5')} AS div_iwm_leads_spx_5d, {fl('m_nikkei < -2.0')} AS div_nikkei_crash, {fl('m5_gold > 1.0 AND m5_spx < -0.5')} AS div_gold_up_spx_down_5d,
          {fl('m_spx < -0.5 AND m_iwm < -0.5 AND m_qqq < -0.5')} AS div_triple_all_down, disp AS div_triple_dispersion, {fl(f"disp > {qt('disp', 20, 0.8)}")} AS div_triple_high_dispersion
          FROM (SELECT *, m5_spx - m5_iwm AS d5, (SELECT stddev_samp(x) FROM (SELECT unnest([m_spx, m_iwm, m_qqq]) AS x) AS u) AS disp FROM pm) AS p""", [*WIDE, MOMS])
def h14(spark, sf):
    return H.momentum_divergence(panel(spark, sf))


@query("H15_options_flow_composite", "d:s pcf_spx_pc_equity_pc_ratio:f9 pcf_spx_pc_equity_pc_ratio_z20:f pcf_composite_level:f pcf_dispersion:f pcf_composite_fear:i pcf_convergence_high:i pcf_vix_pc_mom3d:f pcf_spx_pc_accel:f pcf_spx_pc_x_vix:f pcf_double_fear:i",
       f"""SELECT d, r AS pcf_spx_pc_equity_pc_ratio, {z('r', 20, 10)} AS pcf_spx_pc_equity_pc_ratio_z20, lv AS pcf_composite_level, ds AS pcf_dispersion, {fl('lv > 1.5')} AS pcf_composite_fear, {fl('lv > 1.0 AND ds < 0.5')} AS pcf_convergence_high,
          {mom('vix_pc', 3)} AS pcf_vix_pc_mom3d, (ms - {lg('ms', 3)}) / 100.0 AS pcf_spx_pc_accel, spx_pc * vix / 100 AS pcf_spx_pc_x_vix, {fl(f"spx_pc > {qt('spx_pc', 20, 0.8)} AND vix > 20")} AS pcf_double_fear
          FROM (SELECT *, {MEAN5} AS lv, (SELECT stddev_samp(x) FROM (SELECT unnest([{', '.join(f'z_{a}' for a in FIVE)}]) AS x) AS u) AS ds
                FROM (SELECT *, {sr('spx_pc', 'equity_pc')} AS r, {mom('spx_pc')} AS ms, {", ".join(f"{z(a, 20, 10)} AS z_{a}" for a in FIVE)} FROM panel) AS a) AS p""", WIDE)
def h15(spark, sf):
    return H.options_flow_composite(panel(spark, sf, [*FIVE, "vix"]))


SCORE = "(" + " + ".join(fl(c) for c in ("m_gold > 0.5", "m_dxy > 0.3", "m_bonds10 > 0.2")) + ")"


@query("H16_refuge_triangle", "d:s refuge_gold_dxy_ratio:f refuge_gold_dxy_ratio_z20:f refuge_gold_dxy_ratio_z60:f refuge_ftq_all:i refuge_inflation_stress:i refuge_recession_signal:i refuge_gold_dxy_extreme:i refuge_composite_score:i refuge_composite_max:i refuge_gold_mom5d:f refuge_dxy_strong_move:i",
       f"""SELECT d, r AS refuge_gold_dxy_ratio, {z('r', 20, 10)} AS refuge_gold_dxy_ratio_z20, {z('r', 60, 30)} AS refuge_gold_dxy_ratio_z60, {fl('m_gold > 0.3 AND m_bonds10 > 0.1 AND m_dxy > 0.1')} AS refuge_ftq_all,
          {fl('m_gold > 0.5 AND m_bonds10 < -0.2 AND m_dxy > 0.2')} AS refuge_inflation_stress, {fl('m_bonds10 > 0.3 AND m_dxy < -0.2')} AS refuge_recession_signal, {fl(f"{z('r', 60, 30)} > 2.0")} AS refuge_gold_dxy_extreme,
          {SCORE} AS refuge_composite_score, {fl(f"{SCORE} = 3")} AS refuge_composite_max, m5_gold AS refuge_gold_mom5d, {fl(f"abs({mom('dxy', 5)}) > 2.0")} AS refuge_dxy_strong_move
          FROM (SELECT *, {sr('gold', 'dxy')} AS r FROM pm) AS p""", [*WIDE, MOMS])
def h16(spark, sf):
    return H.refuge_triangle(panel(spark, sf, ["gold", "dxy", "bonds10"]))


@query("H17_cross_frequency_momentum", "d:s cfm_spx_accel_1_5:f cfm_spx_accel_5_20:f cfm_spx_all_aligned_down:i cfm_vix_accel:f cfm_vix_spike_from_low:i cfm_vix_trending_up_5d:i cfm_vix_quad_up_low:i cfm_vix_quad_down_high:i cfm_spx_or30_coherent_5d:i cfm_spx_or30_diverge_1d:i",
       f"""SELECT p.d, m_spx - m5_spx / 5 AS cfm_spx_accel_1_5, m5_spx / 5 - m20_spx / 20 AS cfm_spx_accel_5_20, {fl('m_spx < 0 AND m5_spx < 0 AND m20_spx < 0')} AS cfm_spx_all_aligned_down, m_vix - m5_vix / 5 AS cfm_vix_accel,
          {fl('m_vix > 5 AND vix < 18')} AS cfm_vix_spike_from_low, {fl('m5_vix > 10 AND m_vix > 0')} AS cfm_vix_trending_up_5d, {fl('m_vix > 2')} * (1 - {fl('vix > 20')}) AS cfm_vix_quad_up_low, (1 - {fl('m_vix > 2')}) * {fl('vix > 20')} AS cfm_vix_quad_down_high,
          {fl('(m5_spx > 0 AND o.dir > 0) OR (m5_spx < 0 AND o.dir < 0)')} AS cfm_spx_or30_coherent_5d, 1 - {fl('(m_spx > 0 AND o.dir > 0) OR (m_spx < 0 AND o.dir < 0)')} AS cfm_spx_or30_diverge_1d
          FROM pm AS p LEFT JOIN (SELECT d, CASE WHEN close > open THEN 1 ELSE -1 END AS dir FROM vix) AS o ON p.d = o.d""", [*WIDE, VIX, MOMS])
def h17(spark, sf):
    opening = vix(spark, sf).select("d", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0).alias("or_direction"))
    return H.cross_frequency_momentum(panel(spark, sf, ["spx", "vix"]), opening)


SIGS = [fl("vix > 20"), fl(f"vix > {rs('avg', 'vix', 20)} + {rs('stddev_samp', 'vix', 20)}"), fl("vix9d > vix"), fl(f"spx < {rs('avg', 'spx', 20)}"), fl(f"ad < {rs('avg', 'ad', 10)}"), fl(f"spx_pc > {qt('spx_pc', 20, 0.7)}")]


@query("H18_composite_regimes", "d:s regime_stress_score:i regime_stress_max:i regime_stress_moderate:i regime_calm:i regime_vol_crisis:i regime_vol_stress:i regime_vol_uncertainty:i regime_vol_calm:i regime_spx_bull_strong:i regime_spx_bull_weak:i regime_spx_bear_weak:i",
       f"""SELECT d, s AS regime_stress_score, {fl('s >= 5')} AS regime_stress_max, {fl('s >= 2 AND s < 5')} AS regime_stress_moderate, {fl('s <= 1')} AS regime_calm, {fl('a > 1.5 AND b > 1.5')} AS regime_vol_crisis,
          {fl('a > 0.5 AND b > 0.5 AND NOT (a > 1.5 AND b > 1.5)')} AS regime_vol_stress, {fl('(a > 0.5 AND b <= 0.5) OR (a <= 0.5 AND b > 0.5)')} AS regime_vol_uncertainty, {fl('a <= 0 AND b <= 0')} AS regime_vol_calm,
          {fl('m5_spx > 2 AND m20_spx > 5')} AS regime_spx_bull_strong, {fl('m5_spx > 0 AND m20_spx > 0 AND NOT (m5_spx > 2 AND m20_spx > 5)')} AS regime_spx_bull_weak,
          {fl('m5_spx < 0 AND m20_spx < 0 AND NOT (m5_spx < -2 AND m20_spx < -5)')} AS regime_spx_bear_weak
          FROM (SELECT *, {" + ".join(SIGS)} AS s, {z('vix', 60, 30)} AS a, {z('vvix', 60, 30)} AS b FROM pm) AS p""", [*WIDE, MOMS])
def h18(spark, sf):
    return H.composite_regimes(panel(spark, sf))


@query("H19_assemble_features", "feature n:i", "SELECT feature, (SELECT count(*) FROM panel) AS n FROM (SELECT unnest(['vts_composite_stress', 'refuge_ftq_all', 'regime_calm', 'refuge_dxy_mom5d', 'spx']) AS feature) AS f", WIDE)
def h19(spark, sf):
    p = panel(spark, sf)
    families = [p.select("panel", "d", "spx"), H.vol_term_structure(p), H.refuge_triangle(p), H.composite_regimes(p), p.select("panel", "d", "spx")]
    out = H.assemble_features(families).filter(F.col("feature").isin("vts_composite_stress", "vts_vix_vix6m_spread_accel3", "refuge_ftq_all", "regime_calm", "refuge_dxy_mom5d", "refuge_gold_dxy_ratio_pct252", "spx"))
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("H20_trading_index", "d:s n_series:i", "SELECT d, count(DISTINCT series) AS n_series FROM assets WHERE isodow(d) <= 5 GROUP BY d HAVING count(DISTINCT series) >= (SELECT count(DISTINCT series) FROM assets) * 0.5", [BARS, MARKET, ASSETS])
def h20(spark, sf):
    return H.trading_index(assets(spark, sf))


SPLIT = "days AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM assets) AS u)"


@query("H21_drop_sparse_and_impute", "feature d:s value:f",
       """SELECT f.feature, x.d, coalesce(a.value, f.med) AS value FROM (
          SELECT a.series AS feature, count(*) AS k, max(n) AS n, median(CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN value END) AS med FROM assets AS a JOIN days ON a.d = days.d GROUP BY a.series) AS f
          CROSS JOIN days AS x LEFT JOIN assets AS a ON a.series = f.feature AND a.d = x.d WHERE 1 - f.k * 1.0 / f.n <= 0.20 AND (f.med IS NOT NULL OR f.k = f.n)""", [BARS, MARKET, ASSETS, SPLIT])
def h21(spark, sf):
    return H.drop_sparse_and_impute(assets(spark, sf).withColumnRenamed("series", "feature"), 0.20)


@query("H22_exclude_features", "feature n:i", "SELECT series AS feature, count(*) AS n FROM assets WHERE series NOT LIKE '%vix%' AND series NOT LIKE '%pc%' GROUP BY series", [BARS, MARKET, ASSETS])
def h22(spark, sf):
    return H.exclude_features(assets(spark, sf).withColumnRenamed("series", "feature"), ["vix", "PC"]).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("H23_join_targets", "symbol d:s vix:f y_amp:f y_cat:i",
       """SELECT y.symbol, p.d, p.vix, y.a AS y_amp, CASE WHEN a >= 60 THEN 2 WHEN a <= 20 THEN 0 ELSE 1 END AS y_cat FROM panel AS p JOIN (SELECT symbol, d, abs((close - open) / open * 100.0) AS a FROM bars) AS y ON p.d = y.d""", WIDE)
def h23(spark, sf):
    t = H.daily_targets(bars(spark, sf), 60.0, 20.0)
    return H.join_targets(panel(spark, sf, ["vix"]), t.select("symbol", "d", "y_amp"), "y_amp", 60.0, 20.0, by=["symbol"])


@query("H24_regime_filter", "symbol d:s close:f", "SELECT b.symbol, b.d, b.close FROM bars AS b ASOF JOIN vix AS v ON b.d >= v.d WHERE v.open BETWEEN 15 AND 25", [BARS, VIX])
def h24(spark, sf):
    return H.regime_filter(bars(spark, sf), vix(spark, sf), 15.0, 25.0)


QB = """qb AS (SELECT b.*, CASE WHEN volume <= e.a THEN 'low' WHEN volume <= e.b THEN 'mid' ELSE 'high' END AS bucket
  FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY d) / close - 1 AS fwd FROM bars) AS b
  JOIN (SELECT symbol, quantile_cont(volume, 1.0 / 3.0) AS a, quantile_cont(volume, 2.0 / 3.0) AS b FROM bars GROUP BY symbol) AS e ON b.symbol = e.symbol)"""


@query("H25_quantile_buckets", "symbol bucket n:i n_fwd:i", "SELECT symbol, bucket, count(*) AS n, count(fwd) AS n_fwd FROM qb GROUP BY symbol, bucket", [BARS, QB])
def h25(spark, sf):
    from ..operators.series import forward_return
    rows = forward_return(bars(spark, sf), 1, name="fwd")
    return H.bucket_coverage(H.quantile_buckets(rows, "volume", ("low", "mid", "high")), ["fwd"])
