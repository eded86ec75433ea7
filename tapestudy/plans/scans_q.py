"""Queries of pattern scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import sessions
from ..operators import features as H
from ..operators import joins as J
from ..operators import scans as N
from ..operators import series as S
from .features_q import CALDAYS, caldays
from .inputs import BARS, CALENDAR, EARNINGS, MARKET, VIX, bars, calendar, earnings, market, vix
from .registry import query
from .series_q import RETURNS, roll, W


def tested(source, name="tst", min_is=50.0, min_oos=30.0):
    return f"""{name} AS (SELECT symbol, signal, n, rate_is, CASE WHEN n_oos >= 6 THEN oos END AS rate_oos, med AS median_amp, last_d FROM (
  SELECT symbol, signal, count(*) AS n, avg(CASE WHEN overnight > 0 THEN 100.0 ELSE 0.0 END) FILTER (WHERE rn <= floor(k * CAST(0.7 AS DOUBLE))) AS rate_is,
    avg(CASE WHEN overnight > 0 THEN 100.0 ELSE 0.0 END) FILTER (WHERE rn > floor(k * CAST(0.7 AS DOUBLE))) AS oos, count(*) FILTER (WHERE rn > floor(k * CAST(0.7 AS DOUBLE))) AS n_oos,
    median(overnight) AS med, max(d) AS last_d
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, signal ORDER BY d) AS rn, count(*) OVER (PARTITION BY symbol, signal) AS k FROM {source} WHERE overnight IS NOT NULL) AS a GROUP BY symbol, signal) AS b
  WHERE n >= 20 AND abs(med) >= 0.15 AND rate_is >= {min_is} AND (n_oos < 6 OR oos >= {min_oos}))"""


OVER = f"""ov AS (SELECT b.*, v.close AS vix, c.is_opex, c.is_high_impact, c.days_to_opex, c.days_since_opex,
    (lead(b.open) OVER w - b.close) / b.close * 100.0 AS overnight, (b.open - lag(b.close) OVER w) / lag(b.close) OVER w * 100.0 AS gap
  FROM bars AS b ASOF LEFT JOIN vix AS v ON b.d >= v.d LEFT JOIN (SELECT *, min(CASE WHEN is_opex THEN d END) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - d AS days_to_opex,
    d - max(CASE WHEN is_opex THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_opex FROM caldays) AS c ON c.d = b.d
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.d)),
ovs AS (SELECT *, (close - lag(close, 21) OVER w) / lag(close, 21) OVER w * 100.0 AS m1, (close - lag(close, 63) OVER w) / lag(close, 63) OVER w * 100.0 AS m3, (close - lag(close, 126) OVER w) / lag(close, 126) OVER w * 100.0 AS m6,
  {roll('avg', 'close', 20)} AS ma20, {roll('max', 'close', 252, 50)} AS hi, {roll('min', 'close', 252, 50)} AS lo FROM ov {W})"""
SIGNALS = ["vix > 25=vix > 25", "vix > 20=vix > 20", "vix < 15=vix < 15", "gap < -1=gap < -1.0", "gap > 1=gap > 1.0", "below ma20=close < ma20", "mom 1m > 0=m1 > 0", "mom 1m < 0=m1 < 0", "mom 3m > 0=m3 > 0",
           "mom 6m > 0=m6 > 0", "near 52w high=(hi - close) / hi < 0.02", "near 52w low=(close - lo) / lo < 0.02", "opex day=is_opex", "opex week=coalesce(days_to_opex, 999) <= 2 OR coalesce(days_since_opex, 999) <= 2",
           "high_impact day=is_high_impact", "no high impact=NOT coalesce(is_high_impact, false)"]
SIGROWS = "sg AS (" + " UNION ALL ".join(f"SELECT symbol, d, overnight, {i} AS i, '{s.split('=', 1)[0]}' AS signal FROM ovs WHERE coalesce({s.split('=', 1)[1]}, false) AND overnight IS NOT NULL" for i, s in enumerate(SIGNALS)) + ")"
OV_BASE = [BARS, VIX, CALENDAR, CALDAYS, OVER, SIGROWS]


def overnight_input(spark, sf):
    b = J.asof_join(bars(spark, sf), vix(spark, sf).select("d", F.col("close").alias("vix")), on="d")
    days = H.days_to_since(caldays(spark, sf), "is_opex", "opex").select("d", "is_opex", "is_high_impact", "days_to_opex", "days_since_opex")
    return b.join(days, ["d"], "left")


TEST_COLS = "symbol signal n:i rate_is:f rate_oos:f median_amp:f direction actionable:b"
TEST_SQL = "symbol, signal, n, rate_is, rate_oos, median_amp, CASE WHEN median_amp > 0 THEN 'up' ELSE 'down' END AS direction, rate_is >= 70 AND coalesce(rate_oos, 0) >= 55 AS actionable"


@query("I1_test_signals", TEST_COLS, f"SELECT {TEST_SQL} FROM tst", [*OV_BASE, tested("sg")])
def i1(spark, sf):
    rows, signals = N.overnight_signals(overnight_input(spark, sf))
    matches = N.spread_matches(rows, signals).select("symbol", "d", "overnight", "signal")
    return N.test_signals(matches, min_is=50.0, min_oos=30.0)


@query("I2_overnight_signal_scan", f"{TEST_COLS} kind active_today:b",
       f"""SELECT {TEST_SQL}, kind, last_d = (SELECT max(o.d) FROM ovs AS o WHERE o.symbol = r.symbol AND o.overnight IS NOT NULL) AS active_today FROM (
          SELECT t.*, p.kind, row_number() OVER (PARTITION BY t.symbol, p.kind ORDER BY p.i) AS r FROM tst AS t JOIN (SELECT symbol, signal, max(kind) AS kind, max(i) AS i FROM allsg GROUP BY symbol, signal) AS p
          ON p.symbol = t.symbol AND p.signal = t.signal) AS r""",
       [*OV_BASE, """allsg AS (SELECT symbol, d, overnight, i, signal, 'single' AS kind FROM sg UNION ALL
          SELECT a.symbol, a.d, a.overnight, a.i * 1000 + b.i, a.signal || ' + ' || b.signal, 'pair' FROM sg AS a JOIN sg AS b ON a.symbol = b.symbol AND a.d = b.d AND a.i < b.i)""", tested("allsg")])
def i2(spark, sf):
    return N.overnight_signal_scan(overnight_input(spark, sf), min_is=50.0, min_oos=30.0)


TICK = f"""tk0 AS (SELECT r.*, vma.vm AS vma, volume / vma.vm AS vol_ratio, (open - prev_close) / prev_close * 100.0 AS gap_pct, (high - low) / close * 100.0 AS range_pct FROM ret AS r
  JOIN (SELECT symbol, d, {roll('avg', 'volume', 20)} AS vm FROM bars) AS vma ON vma.symbol = r.symbol AND vma.d = r.d),
tk1 AS (SELECT *, {roll('avg', 'close', 20)} AS ma20, {roll('max', 'close', 252, 20)} AS hi52, {roll('min', 'close', 252, 20)} AS lo52, {roll('max', 'var_pct', 20)} AS max20, {roll('min', 'var_pct', 20)} AS min20,
  {roll('avg', 'range_pct', 5)} AS atr5, {roll('avg', 'range_pct', 20)} AS atr20, CASE WHEN row_number() OVER w >= 3 THEN CASE WHEN volume > lag(volume) OVER w THEN 1 ELSE 0 END + CASE WHEN lag(volume) OVER w > lag(volume, 2) OVER w THEN 1 ELSE 0 END
  + CASE WHEN lag(volume, 2) OVER w > lag(volume, 3) OVER w THEN 1 ELSE 0 END END AS vol_up3,
  CASE WHEN up THEN row_number() OVER (PARTITION BY symbol, up, ur ORDER BY d) ELSE 0 END AS consec_up, CASE WHEN dn THEN row_number() OVER (PARTITION BY symbol, dn, dr ORDER BY d) ELSE 0 END AS consec_dn,
  row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS cnt,
  {", ".join(f"(lead(close, {h}) OVER w - close) / close * 100.0 AS v{h}, lead(close, {h}) OVER w AS c{h}, lead(low, {h}) OVER w AS l{h}" for h in range(1, 6))}, lag(open) OVER w AS po
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - row_number() OVER (PARTITION BY symbol, up ORDER BY d) AS ur, row_number() OVER (PARTITION BY symbol ORDER BY d) - row_number() OVER (PARTITION BY symbol, dn ORDER BY d) AS dr
        FROM (SELECT *, coalesce(var_pct > 0, false) AS up, coalesce(var_pct < 0, false) AS dn FROM tk0) AS a) AS b {W}),
tk2 AS (SELECT *, lag(consec_up) OVER w AS p_up, lag(consec_dn) OVER w AS p_dn, lag(var_pct) OVER w AS p_var, lag(max20) OVER w AS p_max, lag(min20) OVER w AS p_min,
  coalesce(prev_close > po AND close < open AND open >= prev_close AND close <= po AND abs(close - open) > abs(prev_close - po), false) AS be,
  coalesce(prev_close < po AND close > open AND open <= prev_close AND close >= po AND abs(close - open) > abs(prev_close - po), false) AS bu FROM tk1 {W}),
tk AS (SELECT t.*, EXISTS (SELECT 1 FROM earnings AS e WHERE e.symbol = t.symbol AND t.d - e.d BETWEEN -5 AND 5) AS near, EXISTS (SELECT 1 FROM earnings AS e WHERE e.symbol = t.symbol AND t.d - e.d BETWEEN -5 AND -1) AS pre,
  EXISTS (SELECT 1 FROM earnings AS e WHERE e.symbol = t.symbol AND t.d - e.d BETWEEN 1 AND 3) AS post, EXISTS (SELECT 1 FROM earnings AS e WHERE e.symbol = t.symbol AND t.d - e.d BETWEEN 0 AND 1) AS eday FROM tk2 AS t)"""
CANDS = {f"weekday {i}": f"dow = {i}" for i in range(5)} | {f"month {m}": f"month = {m}" for m in range(1, 13)} | {f"quarter {q}": f"quarter(d) = {q}" for q in range(1, 5)}
CANDS |= {"month start": "day(d) <= 10", "month middle": "day(d) > 10 AND day(d) <= 20", "month end": "day(d) > 20"}
for _n in (2, 3, 4, 5):
    CANDS |= {f"after {_n} up": f"p_up >= {_n}", f"after {_n} down": f"p_dn >= {_n}"}
for _n in (3, 5, 7, 10):
    CANDS |= {f"after fall {_n}": f"p_var <= -{_n}", f"after rise {_n}": f"p_var >= {_n}"}
CANDS |= {"after 20d worst": "p_var = p_min", "after 20d best": "p_var = p_max", "volume > 1.5": "vol_ratio > 1.5", "volume > 2": "vol_ratio > 2.0", "volume < 0.5": "vol_ratio < 0.5", "volume rising": "vol_up3 >= 3"}
for _n in (2, 5):
    CANDS |= {f"gap > {_n}": f"gap_pct > {_n}", f"gap < -{_n}": f"gap_pct < -{_n}"}
CANDS |= {"atr compressed": "atr5 < atr20 * 0.5", "range compressed": "range_pct < atr20 * 0.5", "below ma20": "close < ma20", "above ma20": "close > ma20", "near 52w low": "(close - lo52) / lo52 * 100.0 < 5",
          "near 52w high": "(hi52 - close) / hi52 * 100.0 < 5", "before earnings": "pre", "after earnings": "post", "earnings gap > 10": "eday AND gap_pct > 10", "earnings gap < -10": "eday AND gap_pct < -10",
          "volume > 1.5 and fall > 5": "vol_ratio > 1.5 AND var_pct < -5", "volume < 0.5 and rise > 3": "vol_ratio < 0.5 AND var_pct > 3", "volume > 2 and rise > 5": "vol_ratio > 2.0 AND var_pct > 5",
          "gap < -2 on monday": "gap_pct < -2 AND dow = 0", "gap > 2 on friday": "gap_pct > 2 AND dow = 4", "after 3 down, volume rising": "p_dn >= 3 AND vol_up3 >= 3",
          "bearish engulfing": "be AND NOT near", "bearish engulfing validated": "be AND NOT near AND least(c1, c2, c3, c4, c5, l1, l2, l3, l4, l5) <= close * 0.98", "bullish engulfing": "bu AND NOT near",
          "bullish engulfing validated": "bu AND NOT near AND greatest(c1, c2, c3, c4, c5) >= close * 1.02", "bearish engulfing, volume > 1.5": "be AND NOT near AND vol_ratio > 1.5",
          "bullish engulfing, volume > 1.5": "bu AND NOT near AND vol_ratio > 1.5", "bearish engulfing after 3 up": "be AND NOT near AND p_up >= 3"}
CAND_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in CANDS.items()) + "], lambda x: x IS NOT NULL)"


@query("I3_ticker_pattern_scan", "symbol candidate horizon:i n:i median_amp:f mean_amp:f direction rate:f n_oos:i oos_pct:f oos_valid:b actionable:b rank:i",
       f"""SELECT * FROM (SELECT *, coalesce(oos_pct >= 50, false) AS oos_valid, rate >= 95 AND coalesce(oos_pct >= 50, false) AS actionable, row_number() OVER (PARTITION BY symbol ORDER BY rate DESC, candidate, horizon) AS rank FROM (
          SELECT *, CASE WHEN direction = 'up' THEN u * 100.0 / n ELSE dn * 100.0 / n END AS rate, CASE WHEN n_oos >= 6 THEN CASE WHEN direction = 'up' THEN ou ELSE od END * 100.0 / n_oos END AS oos_pct FROM (
            SELECT *, CASE WHEN u * 100.0 / n >= 65 AND median_amp >= 2 THEN 'up' WHEN dn * 100.0 / n >= 65 AND abs(median_amp) >= 2 THEN 'down' END AS direction FROM (
              SELECT symbol, candidate, horizon, count(v) FILTER (WHERE ins) AS n, count(*) FILTER (WHERE ins AND v > 0) AS u, count(*) FILTER (WHERE ins AND v < 0) AS dn, median(v) FILTER (WHERE ins) AS median_amp,
                avg(v) FILTER (WHERE ins) AS mean_amp, count(v) FILTER (WHERE NOT is_) AS n_oos, count(*) FILTER (WHERE NOT is_ AND v > 0) AS ou, count(*) FILTER (WHERE NOT is_ AND v < 0) AS od
              FROM (SELECT symbol, candidate, horizon, v, is_, is_ AND v1 IS NOT NULL AS ins FROM (SELECT symbol, unnest({CAND_LIST}) AS candidate, rn <= floor(cnt * CAST(0.7 AS DOUBLE)) AS is_, v1, v2, v3, v4, v5 FROM tk) AS a
                CROSS JOIN LATERAL (VALUES (1, v1), (2, v2), (3, v3), (4, v4), (5, v5)) AS h(horizon, v)) AS b GROUP BY symbol, candidate, horizon) AS c WHERE n >= 20) AS d WHERE direction IS NOT NULL) AS e) AS f""",
       [BARS, EARNINGS, RETURNS, TICK])
def i3(spark, sf):
    return N.ticker_pattern_scan(bars(spark, sf), earnings(spark, sf))


PATS = {"1_green": "g", "1_red": "r", "2_green": "g AND g1", "2_red": "r AND r1", "3_green": "g AND g1 AND g2", "3_red": "r AND r1 AND r2", "ret_gt_1pct": "ret > 0.01", "ret_lt_m1pct": "ret < -0.01", "ret_abs_gt_1pct": "abs(ret) > 0.01",
        "body_gt_1pct": "abs(ret) > 0.01", "range_gt_2pct": "(high - low) / open > 0.02", "red_red_green": "r2 AND r1 AND g", "green_green_red": "g2 AND g1 AND r", "red_green": "r1 AND g", "green_red": "g1 AND r"}


@query("I4_candle_pattern_discovery", "symbol pattern n:i mean_next:f median_next:f hit_rate:f baseline_hit_rate:f edge:f score:f4",
       """SELECT p.*, b.base AS baseline_hit_rate, hit_rate - base AS edge, abs(mean_next) * 10000.0 * ln(1 + n) + greatest(hit_rate - base, 0) * 100.0 AS score FROM (
          SELECT symbol, pattern, count(*) AS n, avg(nx) AS mean_next, median(nx) AS median_next, avg(CASE WHEN nx > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM ("""
       + " UNION ALL ".join(f"SELECT symbol, nx, '{k}' AS pattern FROM cd WHERE coalesce({c}, false)" for k, c in PATS.items()) +
       """) AS u GROUP BY symbol, pattern HAVING count(*) >= 3) AS p JOIN (SELECT symbol, avg(CASE WHEN nx > 0 THEN 1.0 ELSE 0.0 END) AS base FROM cd GROUP BY symbol) AS b ON p.symbol = b.symbol""",
       [BARS, f"cd AS (SELECT * FROM (SELECT *, lead(ret) OVER w AS nx, lag(g) OVER w AS g1, lag(g, 2) OVER w AS g2, lag(r) OVER w AS r1, lag(r, 2) OVER w AS r2 FROM (SELECT *, (close - open) / open AS ret, close > open AS g, close < open AS r FROM bars) AS a {W}) AS b WHERE nx IS NOT NULL)"])
def i4(spark, sf):
    return N.candle_pattern_discovery(bars(spark, sf))


def all_targets(spark, sf):
    w = sessions("symbol")
    return bars(spark, sf).select("symbol", "d", ((F.col("close") - F.col("open")) / F.col("open") * 100.0).alias("ret_close"), ((F.lead("open").over(w) - F.col("close")) / F.col("close") * 100.0).alias("ret_open_next"))


AFT = "aft AS (SELECT symbol, d, (close - open) / open * 100.0 AS ret_close, (lead(open) OVER (PARTITION BY symbol ORDER BY d) - close) / close * 100.0 AS ret_open_next FROM bars)"
QS = str([0.1 + 0.8 * i / 7 for i in range(8)])
TDC = f"""lv AS (SELECT series, unnest(list_distinct(list_transform(quantile_cont(value, {QS}), lambda x: round(x, 2)))) AS threshold FROM market GROUP BY series HAVING count(*) >= 30),
tdr AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY series, threshold, op ORDER BY d) > floor(sum(CAST(hit AS INT)) OVER (PARTITION BY series, threshold, op) * CAST(0.7 AS DOUBLE)) AS late FROM (
  SELECT m.series, m.d, l.threshold, op, CASE WHEN op = '>' THEN m.value > l.threshold ELSE m.value < l.threshold END AS hit FROM market AS m JOIN lv AS l ON m.series = l.series CROSS JOIN (VALUES ('>'), ('<')) AS o(op)) AS a),
tdc AS (SELECT symbol, series, op, threshold, horizon, count(v) FILTER (WHERE hit) AS n, count(*) FILTER (WHERE hit AND v > 0) AS bull, avg(v) FILTER (WHERE hit) AS mean, count(v) FILTER (WHERE hit AND NOT late) AS train_n,
  count(v) FILTER (WHERE hit AND late) AS oos_n, count(*) FILTER (WHERE hit AND late AND v > 0) AS oos_bull, avg(v) FILTER (WHERE hit AND late) AS oos_mean, count(v) FILTER (WHERE NOT hit) AS inv_n, count(*) FILTER (WHERE NOT hit AND v > 0) AS inv_bull
  FROM (SELECT t.*, h.horizon, h.v FROM (SELECT t.*, a.symbol, a.ret_close, a.ret_open_next FROM tdr AS t JOIN aft AS a ON a.d = t.d) AS t CROSS JOIN LATERAL (VALUES ('ret_close', ret_close), ('ret_open_next', ret_open_next)) AS h(horizon, v)) AS b
  GROUP BY symbol, series, op, threshold, horizon)"""
TD = ("ret_close", "ret_open_next")


@query("I5_threshold_direction_counts", "symbol series op threshold:f horizon n:i bull:i mean:f train_n:i oos_n:i oos_bull:i oos_mean:f inv_n:i inv_bull:i", "SELECT * FROM tdc", [BARS, MARKET, AFT, TDC])
def i5_counts(spark, sf):
    return N.threshold_direction_counts(market(spark, sf), all_targets(spark, sf), TD, target_by=["symbol"])


def pv(k, n):
    return f"""(SELECT least(1.0, sum(exp(l))) FROM (SELECT lgamma({n} + 1) - lgamma(x + 1) - lgamma({n} - x + 1) + x * ln(p) + ({n} - x) * ln(1 - p) AS l FROM (SELECT unnest(generate_series(0, {n})) AS x) AS xs) AS ls
          WHERE l <= lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln(p) + ({n} - {k}) * ln(1 - p) + 1e-7)"""


@query("I5_threshold_direction_scan", "symbol series op threshold:f horizon n:i pct_bull:f mean:f p_value:f oos_n:i oos_pct_bull:f oos_p_value:f invalidated:b",
       f"""SELECT *, bull * 100.0 / n AS pct_bull, oos_bull * 100.0 / oos_n AS oos_pct_bull, coalesce(inv_n >= 30 AND inv_p < 0.4 AND (bull * 100.0 / n > 50) <> (inv_bull * 100.0 / inv_n > 50), false) AS invalidated
          FROM (SELECT *, {pv('bull', 'n')} AS p_value, {pv('oos_bull', 'oos_n')} AS oos_p_value, {pv('inv_bull', 'inv_n')} AS inv_p
                FROM (SELECT tdc.*, base.p FROM tdc JOIN (SELECT symbol, avg(CASE WHEN ret_close > 0 THEN 1.0 ELSE 0.0 END) AS p FROM aft GROUP BY symbol) AS base ON tdc.symbol = base.symbol WHERE n >= 30 AND oos_n >= 30) AS a) AS b WHERE p_value < 0.4 AND oos_p_value < 0.4""", [BARS, MARKET, AFT, TDC])
def i5(spark, sf):
    return N.threshold_direction_scan(market(spark, sf), all_targets(spark, sf), TD, max_p=0.4, target_by=["symbol"])


SUMM = "count(*) AS n, avg(ret) AS mean, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate"
LEVELED = """sfx AS (SELECT symbol, level, c AS condition, sum(k) OVER w AS n, sum(s) OVER w / nullif(sum(k) OVER w, 0) AS mean, sum(p) OVER w * 1.0 / nullif(sum(k) OVER w, 0) AS positive_rate, pos, cnt FROM (
  SELECT symbol, level, c, count(*) FILTER (WHERE on_) AS k, coalesce(sum(ret) FILTER (WHERE on_), 0) AS s, count(*) FILTER (WHERE on_ AND ret > 0) AS p,
    row_number() OVER (PARTITION BY symbol, c ORDER BY level) AS pos, count(*) OVER (PARTITION BY symbol, c) AS cnt
  FROM (SELECT r.symbol, v.close AS level, r.ret, q.c, CASE q.c WHEN 'alone' THEN true WHEN 'dollar_down' THEN coalesce(x.dx < 0, false) ELSE r.d IN (SELECT d FROM calendar WHERE lower(event) LIKE '%cpi%') END AS on_
        FROM rr AS r JOIN vix AS v ON r.d = v.d LEFT JOIN dx AS x ON x.d = r.d CROSS JOIN (VALUES ('alone'), ('dollar_down'), ('cpi')) AS q(c)) AS a GROUP BY symbol, level, c) AS b
  WINDOW w AS (PARTITION BY symbol, c ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
CTX = ["rr AS (SELECT symbol, d, var_pct / 100.0 AS ret FROM ret WHERE var_pct IS NOT NULL)", "dx AS (SELECT d, value - lag(value) OVER (ORDER BY d) AS dx FROM market WHERE series = '5-LOW')", LEVELED]


@query("I19_context_scan", "symbol bucket n:i mean:f positive_rate:f9",
       f"""SELECT symbol, 'month:' || strftime(d, '%Y-%m') AS bucket, {SUMM} FROM rr GROUP BY ALL
          UNION ALL SELECT r.symbol, CASE WHEN dx > 0 THEN 'dollar:up' ELSE 'dollar:down' END AS bucket, {SUMM} FROM rr AS r JOIN dx ON r.d = dx.d WHERE dx <> 0 GROUP BY ALL
          UNION ALL SELECT r.symbol, 'macro:' || k AS bucket, {SUMM} FROM rr AS r JOIN (SELECT DISTINCT d, CASE WHEN lower(event) LIKE '%cpi%' THEN 'cpi' ELSE 'fomc' END AS k FROM calendar WHERE lower(event) LIKE '%cpi%' OR lower(event) LIKE '%fomc%') AS c ON c.d = r.d GROUP BY ALL
          UNION ALL SELECT symbol, 'level>=' || CAST(round(level, 4) AS VARCHAR), n, mean, positive_rate FROM sfx WHERE condition = 'alone' AND n > 0
          UNION ALL SELECT symbol, 'combo:level>=' || CAST(round(level, 4) AS VARCHAR) || CASE WHEN condition = 'alone' THEN '' ELSE ' & ' || condition END, n, mean, positive_rate FROM sfx
          WHERE n >= 5""", [BARS, RETURNS, VIX, MARKET, CALENDAR, *CTX])
def i19(spark, sf):
    dollar = market(spark, sf).filter("series = '5-LOW'").select(F.col("series").alias("symbol"), "d", F.col("value").alias("close"))
    return N.context_scan(bars(spark, sf), vix(spark, sf), calendar(spark, sf), dollar)


@query("I20_pair_outperformance", "symbol month:i n:i mean:f positive_rate:f",
       """SELECT symbol, m AS month, count(*) AS n, avg(s) AS mean, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate FROM (
          SELECT a.symbol, month(a.d) AS m, a.var_pct / 100.0 - v.r AS s FROM ret AS a JOIN (SELECT d, (close - lag(close) OVER (ORDER BY d)) / lag(close) OVER (ORDER BY d) AS r FROM vix) AS v ON a.d = v.d) AS j
          WHERE s IS NOT NULL GROUP BY GROUPING SETS ((symbol), (symbol, m))""", [BARS, RETURNS, VIX])
def i20(spark, sf):
    return N.pair_outperformance(bars(spark, sf), vix(spark, sf))


TREE = f"""trow AS (SELECT m.*, v.vb, x.mb FROM (SELECT symbol, d, (open - lag(close) OVER w) / lag(close) OVER w AS gap, (close - open) / open AS intraday, (lead(close) OVER w - close) / close AS next_close, (lead(close, 3) OVER w - close) / close AS plus3d,
    (lead(close, 5) OVER w - close) / close AS plus5d FROM bars {W}) AS m
  JOIN (SELECT d, CASE WHEN close <= (SELECT median(close) FROM vix) THEN 'low' ELSE 'high' END AS vb FROM vix) AS v ON v.d = m.d
  JOIN (SELECT d, CASE WHEN value <= (SELECT median(value) FROM market WHERE series = '2-HIGH') THEN 'low' ELSE 'high' END AS mb FROM market WHERE series = '2-HIGH') AS x ON x.d = m.d),
tree AS (SELECT symbol, 'vix=' || a || ' | mkt=' || b AS assignment, count(*) AS n, count(*) FILTER (WHERE gap > 0) * 1.0 / count(gap) AS open_up_prob, count(*) FILTER (WHERE gap < 0) * 1.0 / count(gap) AS open_down_prob,
  avg(gap) AS gap_mean, avg(intraday) AS intraday_mean, avg(next_close) AS next_close_mean, avg(plus3d) AS plus3d_mean, avg(plus5d) AS plus5d_mean
  FROM trow CROSS JOIN (VALUES ('low'), ('high')) AS p(a) CROSS JOIN (VALUES ('low'), ('high')) AS q(b) WHERE vb = a OR NOT (mb = b) GROUP BY symbol, a, b HAVING count(*) >= 12)"""


def tree_scan(spark, sf):
    vb = H.quantile_buckets(vix(spark, sf), "close", name="vb").select("d", "vb")
    mb = H.quantile_buckets(market(spark, sf).filter("series = '2-HIGH'"), "value", by="series", name="mb").select("d", "mb")
    rows = N.target_moves(bars(spark, sf)).join(vb, ["d"]).join(mb, ["d"])
    return N.logic_tree_scan(rows, {"vix": "vb", "mkt": "mb"}, ("or", "vix", ("not", "mkt")))


@query("I21_logic_tree_scan", "symbol assignment n:i open_up_prob:f open_down_prob:f gap_mean:f intraday_mean:f next_close_mean:f plus3d_mean:f plus5d_mean:f", "SELECT * FROM tree", [BARS, VIX, MARKET, TREE])
def i21(spark, sf):
    return tree_scan(spark, sf)


@query("I21_logic_tree_all_assignments", "symbol assignment n:i next_close_mean:f rank:i",
       """SELECT symbol, assignment, n, next_close_mean, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, abs(coalesce(plus5d_mean, 0)) DESC, abs(coalesce(next_close_mean, 0)) DESC, assignment) AS rank FROM (
          SELECT symbol, 'a=' || o1.x || ' | b=' || o2.x || ' | c=' || o3.x || ' | e=' || o4.x AS assignment, count(*) AS n, avg(next_close) AS next_close_mean, avg(plus5d) AS plus5d_mean
          FROM (SELECT symbol, d, (lead(close) OVER w - close) / close AS next_close, (lead(close, 5) OVER w - close) / close AS plus5d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS m
          CROSS JOIN (VALUES ('0'), ('1'), ('2')) AS o1(x) CROSS JOIN (VALUES ('0'), ('1'), ('2')) AS o2(x) CROSS JOIN (VALUES ('0'), ('1'), ('2')) AS o3(x) CROSS JOIN (VALUES ('0'), ('1'), ('2')) AS o4(x)
          WHERE CAST(day(d) % 3 AS VARCHAR) = o1.x OR (CAST(month(d) % 3 AS VARCHAR) = o2.x AND CAST(year(d) % 3 AS VARCHAR) = o3.x AND NOT (CAST(quarter(d) % 3 AS VARCHAR) = o4.x))
          GROUP BY symbol, assignment HAVING count(*) >= 12) AS g""", [BARS])
def i21_all(spark, sf):
    """Four drivers with three labels: all 81 assignments."""
    rows = N.target_moves(bars(spark, sf)).withColumns({"k1": (F.dayofmonth("d") % 3).cast("string"), "k2": (F.month("d") % 3).cast("string"), "k3": (F.year("d") % 3).cast("string"), "k4": (F.quarter("d") % 3).cast("string")})
    return N.logic_tree_scan(rows, {"a": "k1", "b": "k2", "c": "k3", "e": "k4"}, ("or", "a", ("and", "b", ("and", "c", ("not", "e")))), labels=("0", "1", "2"))


MAG = "(abs(gap_mean) + abs(intraday_mean) + abs(next_close_mean) + abs(plus3d_mean) + abs(plus5d_mean)) / 5"


@query("I22_score_scan_rows", "symbol assignment sample_score:f magnitude_score:f probability_score:f confidence_score:f confidence_label direction_label n_flags:i priority:f",
       f"""SELECT symbol, assignment, ss AS sample_score, ms AS magnitude_score, ps AS probability_score, 0.5 * ss + 0.3 * ms + 0.2 * ps AS confidence_score,
          CASE WHEN 0.5 * ss + 0.3 * ms + 0.2 * ps >= 0.75 THEN 'strong' WHEN 0.5 * ss + 0.3 * ms + 0.2 * ps >= 0.5 THEN 'medium' ELSE 'weak' END AS confidence_label,
          CASE WHEN dir > 0 THEN 'up' WHEN dir < 0 THEN 'down' ELSE 'neutral' END AS direction_label, CAST(n < 40 AS INT) + CAST(ps < 0.1 AS INT) + CAST(ms < 0.15 AS INT) + CAST(dir = 0 AS INT) AS n_flags,
          (0.5 * ss + 0.3 * ms + 0.2 * ps) * 0.6 + ms * 0.4 AS priority
          FROM (SELECT *, CASE WHEN n >= 300 THEN 1.0 WHEN n >= 150 THEN 0.8 WHEN n >= 80 THEN 0.6 WHEN n >= 40 THEN 0.4 WHEN n >= 20 THEN 0.25 ELSE 0.1 END AS ss, least(1.0, {MAG} / 0.02) AS ms,
                abs(CASE WHEN open_up_prob >= open_down_prob THEN open_up_prob ELSE open_down_prob END - 0.5) * 2.0 AS ps, gap_mean + intraday_mean + next_close_mean + plus3d_mean + plus5d_mean AS dir FROM tree) AS t""", [BARS, VIX, MARKET, TREE])
def i22(spark, sf):
    return N.score_scan_rows(tree_scan(spark, sf)).withColumn("n_flags", F.size("flags"))


@query("I23_rare_edge_scan", "symbol feature value n:i freq:f mean_return:f edge_score:f rank:i",
       """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY edge_score DESC, feature, value) AS rank FROM (SELECT g.*, n * 1.0 / t AS freq, (1 - n * 1.0 / t) * abs(mean_return) AS edge_score FROM (
          SELECT symbol, feature, value, count(*) AS n, avg(next_var) AS mean_return FROM (SELECT symbol, 'dow' AS feature, CAST(dow AS VARCHAR) AS value, next_var FROM ret UNION ALL SELECT symbol, 'month', CAST(month AS VARCHAR), next_var FROM ret) AS u
          GROUP BY symbol, feature, value HAVING count(*) >= 20) AS g JOIN (SELECT symbol, count(*) AS t FROM ret GROUP BY symbol) AS c ON c.symbol = g.symbol) AS h""", [BARS, RETURNS])
def i23(spark, sf):
    return N.rare_edge_scan(S.returns(bars(spark, sf)), ["dow", "month"], "next_var")
