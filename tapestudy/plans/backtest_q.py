"""Queries of backtests, universe jobs and option structures (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as T
from ..operators import candles as C
from .inputs import BARS, CHAINS, EARNINGS, FEEDBACK, UNIVERSE, VIX, bars, chains, earnings, feedback, table, universe, vix
from .registry import query
from .series_q import W


@query("J1_signal_backtest", "symbol n:i mean_ret:f median_ret:f hit_rate:f log_growth:f",
       f"""SELECT symbol, count(*) AS n, avg(r) AS mean_ret, median(r) AS median_ret, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, ln(product(1 + r)) AS log_growth FROM (
          SELECT symbol, close < open AND lag(close < open) OVER w AND lag(close < open, 2) OVER w AND lag(close < open, 3) OVER w AND lag(close < open, 4) OVER w AS hit, (lead(close) OVER w - lead(open) OVER w) / lead(open) OVER w AS r FROM bars {W}) AS a
          WHERE hit AND r IS NOT NULL GROUP BY symbol""", [BARS])
def j1(spark, sf):
    """After five red bars in a row; the compounded return is compared on a log scale."""
    rows = C.color_sequence(bars(spark, sf), ["red"] * 5)
    return T.signal_backtest(rows, "sequence").withColumn("log_growth", F.log1p("compounded"))


DRIFT = f"""dm AS (SELECT e.symbol, e.d, e.timing, e.session, b.j_close, b.entry_d, b.entry_open, b.exit_d, b.exit_close, b.var_j, b.mx AS max_pre_ratio, b.av AS avg_pre_ratio, b.ratios FROM (
    SELECT e.symbol, e.d, e.timing, b.d AS session FROM (SELECT *, CASE WHEN timing = 'bmo' THEN d ELSE d + 1 END AS t FROM earnings) AS e ASOF JOIN bars AS b ON e.symbol = b.symbol AND e.t <= b.d) AS e
  JOIN (SELECT *, list_max(ratios) AS mx, list_avg(ratios) AS av FROM (
    SELECT symbol, d, close AS j_close, lead(d) OVER w AS entry_d, lead(open) OVER w AS entry_open, lead(d, 5) OVER w AS exit_d, lead(close, 5) OVER w AS exit_close, (close - lag(close) OVER w) / lag(close) OVER w AS var_j, row_number() OVER w AS i,
      list_transform(list(high - low) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), lambda x: x / nullif(avg(high - low) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)) AS ratios
    FROM bars {W}) AS a WHERE i > 20 AND exit_d IS NOT NULL) AS b ON b.symbol = e.symbol AND b.d = e.session)"""
DRIFT = DRIFT.replace("""list_transform(list(high - low) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), lambda x: x / nullif(avg(high - low) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)) AS ratios""",
                      "[" + ", ".join(f"lag(high - low, {k}) OVER w / nullif(avg(high - low) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)" for k in range(5, 0, -1)) + "] AS ratios")
PEAD = """sig AS (SELECT *, CASE WHEN var_j >= 0.1 THEN 'long' ELSE 'short' END AS direction, var_j * 100.0 AS var_j_pct, CASE WHEN var_j >= 0.1 THEN 1 ELSE -1 END * ((exit_close - entry_open) / entry_open * 100.0) AS pnl_pct
  FROM dm WHERE {fit} AND (var_j >= 0.1 OR var_j <= -0.1))"""
AVG = PEAD.format(fit="avg_pre_ratio < 0.9")
BASE = [BARS, EARNINGS, DRIFT]
SIG_COLS = "symbol d:s session:s direction var_j_pct:f avg_pre_ratio:f max_pre_ratio:f entry_d:s entry_open:f exit_d:s exit_close:f pnl_pct:f"


@query("J2_pead_signals", SIG_COLS, "SELECT * FROM sig", [*BASE, AVG])
def j2(spark, sf):
    return T.pead_signals(bars(spark, sf), earnings(spark, sf), compression=0.9, mode="avg")


@query("J2_pead_signals_n_of_5", SIG_COLS, "SELECT * FROM sig", [*BASE, PEAD.format(fit="len(list_filter(ratios, lambda x: x < 1.0)) >= 3")])
def j2_n_of_5(spark, sf):
    return T.pead_signals(bars(spark, sf), earnings(spark, sf), compression=1.0, mode="n_of_5", n_of_5=3)


@query("J2_pead_signals_median", SIG_COLS, "SELECT * FROM sig", [*BASE, PEAD.format(fit="list_median(ratios) < 0.9")])
def j2_median(spark, sf):
    return T.pead_signals(bars(spark, sf), earnings(spark, sf), compression=0.9, mode="median")


SUMMARY_COLS = "n_signals:i n_long:i n_short:i win_rate:f avg_pnl:f median_pnl:f best_pnl:f worst_pnl:f long_win_rate:f short_win_rate:f long_avg_pnl:f short_avg_pnl:f"
SUMMARY = """count(*) AS n_signals, count(*) FILTER (WHERE direction = 'long') AS n_long, count(*) FILTER (WHERE direction = 'short') AS n_short, avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0.0 END) AS win_rate, avg(pnl_pct) AS avg_pnl,
          median(pnl_pct) AS median_pnl, max(pnl_pct) AS best_pnl, min(pnl_pct) AS worst_pnl, avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0.0 END) FILTER (WHERE direction = 'long') AS long_win_rate,
          avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0.0 END) FILTER (WHERE direction = 'short') AS short_win_rate, avg(pnl_pct) FILTER (WHERE direction = 'long') AS long_avg_pnl, avg(pnl_pct) FILTER (WHERE direction = 'short') AS short_avg_pnl"""


def backtest(spark, sf):
    return T.pead_backtest(bars(spark, sf), earnings(spark, sf), universe(spark, sf), compression=0.9, mode="avg")


@query("J3_pead_backtest", f"{SIG_COLS} sector market_cap:f n_analysts:i", "SELECT s.*, u.sector, u.market_cap, u.n_analysts FROM sig AS s JOIN universe AS u ON u.symbol = s.symbol", [*BASE, AVG, UNIVERSE])
def j3(spark, sf):
    return backtest(spark, sf)


@query("J3_backtest_summary", SUMMARY_COLS, f"SELECT {SUMMARY} FROM sig", [*BASE, AVG])
def j3_summary(spark, sf):
    return T.backtest_summary(backtest(spark, sf))


@query("J4_parameter_sweep", f"config {SUMMARY_COLS}",
       f"""SELECT config, {SUMMARY} FROM (SELECT c.config, CASE WHEN var_j > 0 THEN 'long' ELSE 'short' END AS direction, CASE WHEN var_j > 0 THEN 1 ELSE -1 END * ((exit_close - entry_open) / entry_open * 100.0) AS pnl_pct FROM dm
          CROSS JOIN (VALUES ('avg .9'), ('all 1.2'), ('avg .9 long 20')) AS c(config) WHERE (config = 'avg .9' AND avg_pre_ratio < 0.9 AND abs(var_j) >= 0.1) OR (config = 'all 1.2' AND max_pre_ratio < 1.2 AND abs(var_j) >= 0.1)
          OR (config = 'avg .9 long 20' AND avg_pre_ratio < 0.9 AND var_j >= 0.2)) AS x GROUP BY config""", BASE)
def j4(spark, sf):
    return T.parameter_sweep(bars(spark, sf), earnings(spark, sf), [
        {"name": "avg .9", "compression": 0.9, "mode": "avg"}, {"name": "all 1.2", "compression": 1.2, "mode": "all"},
        {"name": "avg .9 long 20", "compression": 0.9, "mode": "avg", "surprise": 0.2, "side": "long"}])


def lab(v, edges, labels):
    return f"CASE WHEN {v} IS NULL THEN 'unknown' " + " ".join(f"WHEN {v} < {e} THEN '{n}'" for e, n in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"


ENR = f"""enr AS (SELECT s.*, u.beta, u.n_analysts, month(session) AS month, isodow(session) - 1 AS weekday, (c1 - c0) / c0 * 100.0 AS pre_trend_20d_pct, v.close AS vix_at_j,
  CASE WHEN market_cap_b < 100 THEN '[' || CAST(CAST(floor(market_cap_b / 10) * 10 AS INT) AS VARCHAR) || '-' || CAST(CAST(floor(market_cap_b / 10) * 10 + 10 AS INT) AS VARCHAR) || 'B]'
       ELSE '[' || CAST(CAST(floor(market_cap_b / 100) * 100 AS INT) AS VARCHAR) || '-' || CAST(CAST(floor(market_cap_b / 100) * 100 + 100 AS INT) AS VARCHAR) || 'B]' END AS cap_bucket,
  CASE WHEN u.n_analysts = 0 THEN '0' WHEN u.n_analysts <= 5 THEN '1-5' WHEN u.n_analysts <= 10 THEN '6-10' WHEN u.n_analysts <= 15 THEN '11-15' WHEN u.n_analysts <= 20 THEN '16-20' WHEN u.n_analysts <= 30 THEN '21-30' ELSE '31+' END AS analyst_bucket,
  {lab('abs(var_j_pct)', (12, 15, 20, 30), ('10-12%', '12-15%', '15-20%', '20-30%', '30%+'))} AS surprise_bucket, {lab('u.beta', (0.8, 1.2, 1.6), ('low', 'normal', 'high', 'very_high'))} AS beta_bucket,
  {lab('((c1 - c0) / c0 * 100.0)', (-10, -3, 3, 10), ('strong_down', 'down', 'flat', 'up', 'strong_up'))} AS pre_trend_bucket, {lab('v.close', (15, 20, 25, 30), ('calm', 'normal', 'elevated', 'stressed', 'crisis'))} AS vix_regime,
  {lab('v.close', (18,), ('low', 'high'))} AS vix_broad
  FROM (SELECT s.*, p.c0, p.c1 FROM sig AS s JOIN (SELECT symbol, d, coalesce(lag(close, 21) OVER w, lag(close, 20) OVER w) AS c0, lag(close) OVER w AS c1 FROM bars {W}) AS p ON p.symbol = s.symbol AND p.d = s.session) AS s
  JOIN (SELECT *, market_cap / 10.0 AS market_cap_b FROM universe) AS u ON u.symbol = s.symbol ASOF LEFT JOIN vix AS v ON s.session >= v.d)"""


def enriched(spark, sf):
    b = bars(spark, sf)
    sig = backtest(spark, sf).withColumn("market_cap_b", F.col("market_cap") / 10.0)
    return T.enrich_signals(sig, b, vix(spark, sf))


@query("J5_enrich_signals", "symbol session:s month:i weekday:i cap_bucket analyst_bucket surprise_bucket beta_bucket pre_trend_20d_pct:f pre_trend_bucket vix_at_j:f vix_regime vix_broad pnl_pct:f", "SELECT * FROM enr", [*BASE, AVG, UNIVERSE, VIX, ENR])
def j5(spark, sf):
    return enriched(spark, sf)


TRADES = "count(*) AS n, avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0.0 END) AS win_rate, avg(pnl_pct) AS avg_pnl, median(pnl_pct) AS median_pnl"


@query("J6_bucket_stats", "vix_regime n:i win_rate:f avg_pnl:f median_pnl:f", f"SELECT vix_regime, {TRADES} FROM enr GROUP BY vix_regime HAVING count(*) >= 3", [*BASE, AVG, UNIVERSE, VIX, ENR])
def j6(spark, sf):
    return T.bucket_stats(enriched(spark, sf), "vix_regime")


@query("J7_cross_buckets", "combo vix_regime pre_trend_bucket weekday:i n:i win_rate:f avg_pnl:f median_pnl:f",
       f"""SELECT 'vix_regime x pre_trend_bucket' AS combo, vix_regime, pre_trend_bucket, CAST(NULL AS INT) AS weekday, {TRADES} FROM enr GROUP BY vix_regime, pre_trend_bucket HAVING count(*) >= 2 AND avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0.0 END) >= 50
          UNION ALL SELECT 'vix_regime x weekday', vix_regime, NULL, weekday, {TRADES} FROM enr GROUP BY vix_regime, weekday HAVING count(*) >= 2 AND avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0.0 END) >= 50
          UNION ALL SELECT 'vix_regime x pre_trend_bucket x weekday', vix_regime, pre_trend_bucket, weekday, {TRADES} FROM enr GROUP BY vix_regime, pre_trend_bucket, weekday HAVING count(*) >= 2 AND avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0.0 END) >= 50""",
       [*BASE, AVG, UNIVERSE, VIX, ENR])
def j7(spark, sf):
    return T.cross_buckets(enriched(spark, sf), [("vix_regime", "pre_trend_bucket"), ("vix_regime", "weekday"), ("vix_regime", "pre_trend_bucket", "weekday")], 2, 50.0)


@query("J8_build_universe", "symbol market_cap:f n_analysts:i sector", "SELECT c_name AS symbol, c_acctbal * 1e6 AS market_cap, c_nationkey AS n_analysts, c_mktsegment AS sector FROM customer WHERE c_acctbal BETWEEN 2000 AND 9000 AND c_mktsegment NOT IN ('BUILDING')")
def j8(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("symbol"), (F.col("c_acctbal") * 1e6).alias("market_cap"), F.col("c_nationkey").alias("n_analysts"), F.col("c_mktsegment").alias("sector"))
    return T.build_universe(c, 2e9, 9e9, ["BUILDING"])


@query("J8_beta_screen", "symbol cap_usd:f beta:f", """SELECT * FROM (SELECT s_name AS symbol, round(abs(s_acctbal), 2) * CASE s_nationkey % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1e9 END AS cap_usd, s_nationkey / 5.0 AS beta FROM supplier) AS s
          WHERE cap_usd >= 1e9 AND beta >= 2.0""")
def j8_beta(spark, sf):
    unit = F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("B")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("symbol"), F.concat(F.format_string("%.2f", F.abs("s_acctbal")), unit).alias("cap_text"), (F.col("s_nationkey") / 5.0).alias("beta"))
    return T.beta_screen(s)


@query("J9_daily_scan_pre", "symbol d:s days_until:i compression_ratio:f",
       """SELECT e.symbol, e.d, e.d - DATE '1998-06-25' AS days_until, s.r AS compression_ratio FROM earnings AS e JOIN (SELECT symbol, max(CASE WHEN rn <= 5 THEN high - low END) / avg(high - low) AS r FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars WHERE d <= DATE '1998-06-25') AS b WHERE rn <= 20 GROUP BY symbol) AS s ON s.symbol = e.symbol
          WHERE e.d - DATE '1998-06-25' BETWEEN 1 AND 90 AND r < 2.5""", [BARS, EARNINGS])
def j9_pre(spark, sf):
    return T.daily_scan(bars(spark, sf), earnings(spark, sf), "1998-06-25", window=90, compression=2.5)[0]


# bars known on the day of the scan, and trades that are not over
LIVE = [BARS.replace("bars AS (", "allbars AS (", 1), "bars AS (SELECT * FROM allbars WHERE d <= DATE '1996-09-18')", EARNINGS, DRIFT.replace(" AND exit_d IS NOT NULL", "")]


@query("J9_daily_scan_signals", "symbol d:s session:s direction entry_d:s exit_d:s pnl_pct:f", "SELECT * FROM sig WHERE d IN (DATE '1996-09-17', DATE '1996-09-18')", [*LIVE, PEAD.format(fit="max_pre_ratio < 5.0").replace("0.1", "0.001")])
def j9_signals(spark, sf):
    return T.daily_scan(bars(spark, sf), earnings(spark, sf), "1996-09-18", compression=5.0, surprise=0.001)[1]


def nearest(target, name):
    return f"""{name} AS (SELECT chain_id, setting, call_bid, call_ask, put_bid, put_ask FROM (SELECT c.*, a.setting, row_number() OVER (PARTITION BY c.chain_id, a.setting ORDER BY abs(c.strike - ({target})), c.strike) AS rn FROM chains AS c JOIN wing AS a ON a.chain_id = c.chain_id) AS q WHERE rn = 1)"""


WING = """wing AS (SELECT a.chain_id, a.atm, w.* FROM (SELECT chain_id, strike AS atm FROM chains QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY abs(call_delta - 0.5) + abs(abs(put_delta) - 0.5), strike) = 1) AS a
  CROSS JOIN (VALUES ('pur 30', 0, 30), ('pur 40', 0, 40), ('zone 20-40', 20, 40), ('zone 15-40', 15, 40)) AS w(setting, near_, far_))"""


@query("J10_price_structures", "chain_id atm:f setting debit:f credit:f long_max_gain:f short_max_gain:f long_verdict short_verdict is_best:b",
       f"""SELECT *, {{v1}} AS long_verdict, {{v2}} AS short_verdict, row_number() OVER (PARTITION BY chain_id ORDER BY greatest(long_max_gain, short_max_gain) DESC, setting) = 1 AS is_best FROM (
          SELECT w.chain_id, w.atm, w.setting, n.call_ask + p.put_ask - f.call_bid - g.put_bid AS debit, n.call_bid + p.put_bid - f.call_ask - g.put_ask AS credit,
          far_ - near_ - (n.call_ask + p.put_ask - f.call_bid - g.put_bid) AS long_max_gain, n.call_bid + p.put_bid - f.call_ask - g.put_ask AS short_max_gain
          FROM wing AS w JOIN q1 AS n USING (chain_id, setting) JOIN q2 AS p USING (chain_id, setting) JOIN q3 AS f USING (chain_id, setting) JOIN q4 AS g USING (chain_id, setting)) AS s""".format(
           v1="CASE WHEN long_max_gain >= 8 THEN 'excellent' WHEN long_max_gain >= 3 THEN 'viable' WHEN long_max_gain >= 0.5 THEN 'marginal' ELSE 'unprofitable' END",
           v2="CASE WHEN short_max_gain >= 8 THEN 'excellent' WHEN short_max_gain >= 3 THEN 'viable' WHEN short_max_gain >= 0.5 THEN 'marginal' ELSE 'unprofitable' END"),
       [CHAINS, WING, nearest("a.atm + a.near_", "q1"), nearest("a.atm - a.near_", "q2"), nearest("a.atm + a.far_", "q3"), nearest("a.atm - a.far_", "q4")])
def j10(spark, sf):
    return T.price_structures(chains(spark, sf))


LEVELS = "levels AS (SELECT size * 1.0 AS level, price AS gain, price * 2 AS loss FROM (SELECT p_size AS size, round(avg(p_retailprice) / 100.0, 4) AS price FROM part GROUP BY p_size) AS p)"


@query("J11_interpolate_by_level", "d:s x:f gain:f loss:f",
       """SELECT v.d, v.close AS x, lo.gain + coalesce((hi.gain - lo.gain) * greatest(v.close - lo.level, 0) / (hi.level - lo.level), 0) AS gain, lo.loss + coalesce((hi.loss - lo.loss) * greatest(v.close - lo.level, 0) / (hi.level - lo.level), 0) AS loss
          FROM vix AS v JOIN levels AS lo ON lo.level = coalesce((SELECT max(level) FROM levels WHERE level <= v.close), (SELECT min(level) FROM levels)) LEFT JOIN levels AS hi ON hi.level = (SELECT min(level) FROM levels AS l2 WHERE l2.level > lo.level)""", [VIX, LEVELS])
def j11(spark, sf):
    p = table(spark, sf, "part").groupBy("p_size").agg(F.round(F.avg("p_retailprice") / 100.0, 4).alias("gain"))
    levels = p.select((F.col("p_size") * 1.0).alias("level"), "gain", (F.col("gain") * 2).alias("loss"))
    return T.interpolate_by_level(vix(spark, sf).select("d", F.col("close").alias("x")), levels)


PNL = """pl AS (SELECT d, structure, CASE structure
    WHEN 'RIC' THEN CASE WHEN mv >= 40 THEN g WHEN mv >= 20 THEN (mv - 20) / 20 * g - (1 - (mv - 20) / 20) * (40 - g) ELSE greatest(-(40 - g) * (1 - mv / 20) * 0.8, -(40 - g)) END
    WHEN 'IC' THEN CASE WHEN hl <= 24 THEN g WHEN hl <= 40 THEN (40 - hl) / 16 * g ELSE greatest(g - (hl - 40) * 1.2, g - 40) END
    WHEN 'RIB' THEN CASE WHEN mv >= 40 THEN g WHEN mv >= 20 THEN (mv - 20) / 20 * g ELSE greatest(-(20 - g) * (1 - mv / 20), -(20 - g)) END
    ELSE CASE WHEN hl <= 20 THEN g WHEN hl <= 40 THEN (40 - hl) / 20 * g ELSE greatest(g - (hl - 40), g - 40) END END AS pnl
  FROM (SELECT d, structure, (high - low) AS hl, abs(close - open) AS mv, CASE structure WHEN 'RIC' THEN open / 4 WHEN 'IC' THEN open / 5 WHEN 'RIB' THEN open / 8 ELSE open / 6 END AS g
        FROM vix CROSS JOIN (VALUES ('RIC'), ('IC'), ('RIB'), ('IB')) AS s(structure)) AS a)"""


def pnl(spark, sf):
    o = F.col("open")
    rows = vix(spark, sf).select("symbol", "d", (F.col("high") - F.col("low")).alias("amplitude_hl"), F.abs(F.col("close") - o).alias("move_abs"), (o / 4).alias("ric_gain"), (o / 5).alias("ic_gain"), (o / 8).alias("rib_gain"), (o / 6).alias("ib_gain"))
    return T.structure_pnl(rows)


@query("J12_structure_pnl", "d:s structure pnl:f9", "SELECT * FROM pl", [VIX, PNL])
def j12(spark, sf):
    return pnl(spark, sf)


@query("J12_structure_summary", "structure n_trades:i win_rate:f avg_pnl:f total_pnl:f max_gain:f9 max_loss:f9 is_best:b",
       """SELECT *, row_number() OVER (ORDER BY avg_pnl DESC, structure) = 1 AS is_best FROM (SELECT structure, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 100.0 ELSE 0.0 END) AS win_rate, avg(pnl) AS avg_pnl, sum(pnl) AS total_pnl,
          max(pnl) AS max_gain, min(pnl) AS max_loss FROM pl GROUP BY structure) AS g""", [VIX, PNL])
def j12_summary(spark, sf):
    return T.structure_summary(pnl(spark, sf))


@query("J13_feedback_summary", "label engine app_version n:i", "SELECT label, engine, app_version, count(*) AS n FROM feedback GROUP BY GROUPING SETS ((label), (engine, label), (app_version, label))", [FEEDBACK])
def j13(spark, sf):
    return T.feedback_summary(feedback(spark, sf))


@query("J13_latest_per_label", "label event_id:i ts:s rank:i", "SELECT * FROM (SELECT label, event_id, date_trunc('second', ts) AS ts, row_number() OVER (PARTITION BY label ORDER BY feedback.ts DESC, event_id DESC) AS rank FROM feedback) AS f WHERE rank <= 10", [FEEDBACK])
def j13_latest(spark, sf):
    return T.latest_per_label(feedback(spark, sf)).withColumn("ts", F.window("ts", "1 second")["start"])
