"""Queries of series joins (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import joins as J
from .inputs import (BARS, CHAINS, EARNINGS, INTRADAY, MARKET, TICKS, UNIVERSE, VIX, bars, chains, earnings, intraday, market, ticks,
                     universe, vix)
from .registry import query


@query("C1_align", "d:s symbol stock_close:f vix_close:f",
       "SELECT b.d, b.symbol AS symbol, b.close AS stock_close, v.close AS vix_close FROM bars AS b JOIN vix AS v ON b.d = v.d", [BARS, VIX])
def c1(spark, sf):
    return J.align({"stock": bars(spark, sf), "vix": vix(spark, sf)}).withColumnRenamed("stock_symbol", "symbol")


@query("C2_left_merge_conditions", "symbol d:s fear:b calm:b",
       """SELECT symbol, d, coalesce(close > 30, false) AS fear, coalesce(close < 15, false) AS calm
          FROM (SELECT b.symbol, b.d, v.close FROM bars AS b LEFT JOIN vix AS v ON b.d = v.d) AS j""", [BARS, VIX])
def c2(spark, sf):
    v = vix(spark, sf)
    conds = {"fear": P.dates_where(v, F.col("close") > 30), "calm": P.dates_where(v, F.col("close") < 15)}
    return J.left_merge_conditions(bars(spark, sf), conds)


@query("C3_asof_backward", "symbol d:s value:f matched:s",
       """SELECT b.symbol, b.d, m.value, m.d AS matched FROM bars AS b ASOF LEFT JOIN
          (SELECT d, value FROM market WHERE series = '1-URGENT') AS m ON b.d >= m.d""", [BARS, MARKET])
def c3_backward(spark, sf):
    right = market(spark, sf).filter("series = '1-URGENT'").select("d", "value")
    return J.asof_join(bars(spark, sf), right, on="d", right_time="matched")


@query("C3_asof_strict_by", "symbol seq:i last_close:f bar_ts:s",
       """SELECT t.symbol, t.seq, i.close AS last_close, i.ts AS bar_ts FROM ticks AS t ASOF LEFT JOIN intraday AS i
          ON t.symbol = i.symbol AND t.ts > i.ts""", [TICKS, INTRADAY()])
def c3_strict(spark, sf):
    right = intraday(spark, sf).select("symbol", "ts", F.col("close").alias("last_close"))
    return J.asof_join(ticks(spark, sf), right, on="ts", by="symbol", allow_exact=False, chunk="day", right_time="bar_ts", right_unique=True)


@query("C3_asof_forward", "symbol d:s value:f matched:s",
       """SELECT b.symbol, b.d, m.value, m.d AS matched FROM bars AS b ASOF LEFT JOIN
          (SELECT d, value FROM market WHERE series = '2-HIGH') AS m ON b.d <= m.d""", [BARS, MARKET])
def c3_forward(spark, sf):
    right = market(spark, sf).filter("series = '2-HIGH'").select("d", "value")
    return J.asof_join(bars(spark, sf), right, on="d", direction="forward", right_time="matched")


NEAREST = """SELECT symbol, d, value, matched FROM (
          SELECT b.symbol, b.d, m.value, m.d AS matched,
                 row_number() OVER (PARTITION BY b.symbol, b.d ORDER BY abs(date_diff('day', b.d, m.d)), m.d {tie}) AS rn
          FROM bars AS b LEFT JOIN (SELECT d, value FROM market WHERE series = '3-MEDIUM') AS m
            ON m.d BETWEEN b.d - 2 AND b.d + 2) AS j WHERE rn = 1"""


@query("C3_asof_nearest", "symbol d:s value:f matched:s", NEAREST.format(tie=""), [BARS, MARKET])
def c3_nearest(spark, sf):
    right = market(spark, sf).filter("series = '3-MEDIUM'").select("d", "value")
    return J.asof_join(bars(spark, sf), right, on="d", direction="nearest", tolerance=2, right_time="matched")


@query("C3_asof_nearest_later", "symbol d:s value:f matched:s", NEAREST.format(tie="DESC"), [BARS, MARKET])
def c3_nearest_later(spark, sf):
    right = market(spark, sf).filter("series = '3-MEDIUM'").select("d", "value")
    return J.asof_join(bars(spark, sf), right, on="d", direction="nearest", tolerance=2, tie="later", right_time="matched")


@query("C4_ffill_to_index", "series d:s value:f",
       """SELECT s.series, i.d, m.value FROM (SELECT DISTINCT d FROM bars) AS i CROSS JOIN (SELECT DISTINCT series FROM market) AS s
          ASOF JOIN market AS m ON s.series = m.series AND i.d >= m.d""", [BARS, MARKET])
def c4(spark, sf):
    return J.ffill_to_index(market(spark, sf), bars(spark, sf).select("d"))


@query("C5_event_to_session", "symbol d:s timing session:s",
       """SELECT e.symbol, e.d, e.timing, b.d AS session FROM (SELECT *, CASE WHEN timing = 'bmo' THEN d ELSE d + 1 END AS t FROM earnings) AS e
          ASOF LEFT JOIN bars AS b ON e.symbol = b.symbol AND e.t <= b.d""", [EARNINGS, BARS])
def c5(spark, sf):
    return J.event_to_session(earnings(spark, sf), bars(spark, sf))


@query("C6_semi_anti_dates", "symbol d:s close:f",
       "SELECT symbol, d, close FROM bars WHERE d IN (SELECT d FROM vix WHERE close > 25) AND d NOT IN (SELECT d FROM vix WHERE open > 40)", [BARS, VIX])
def c6(spark, sf):
    v = vix(spark, sf)
    return J.anti_dates(J.semi_dates(bars(spark, sf), v.filter("close > 25").select("d")), v.filter("open > 40").select("d"))


@query("C7_pairwise_join", "a b d:s value_a:f value_b:f",
       """SELECT a.symbol AS a, b.symbol AS b, a.d, a.close AS value_a, b.close AS value_b FROM bars AS a JOIN bars AS b
          ON a.d = b.d AND a.symbol < b.symbol AND substr(a.symbol, 1, 1) <> substr(b.symbol, 1, 1)""", [BARS])
def c7(spark, sf):
    b = bars(spark, sf)
    families = b.select(F.col("symbol").alias("series"), F.substring("symbol", 1, 1).alias("family")).distinct()
    return J.pairwise_join(b.select(F.col("symbol").alias("series"), "d", F.col("close").alias("value")), families)


@query("C8_enrich_with_dimension", "symbol d:s sector market_cap:f n_analysts:i",
       "SELECT b.symbol, b.d, u.sector, u.market_cap, u.n_analysts FROM bars AS b LEFT JOIN universe AS u ON b.symbol = u.symbol", [BARS, UNIVERSE])
def c8(spark, sf):
    return J.enrich_with_dimension(bars(spark, sf), universe(spark, sf))


@query("C9_nearest_strike", "chain_id leg strike:f call_bid:f put_ask:f",
       """SELECT chain_id, leg, strike, call_bid, put_ask FROM (
          SELECT c.*, t.leg, row_number() OVER (PARTITION BY c.chain_id, t.leg ORDER BY abs(c.strike - t.target), c.strike) AS rn
          FROM chains AS c JOIN (SELECT chain_id, 'up' AS leg, avg(strike) + 12 AS target FROM chains GROUP BY chain_id
                 UNION ALL SELECT chain_id, 'down', avg(strike) - 12 FROM chains GROUP BY chain_id) AS t ON c.chain_id = t.chain_id) AS q WHERE rn = 1""", [CHAINS])
def c9(spark, sf):
    c = chains(spark, sf)
    mid = c.groupBy("chain_id").agg(F.avg("strike").alias("m"))
    legs = F.explode(F.array(F.struct(F.lit("up").alias("leg"), (F.col("m") + 12).alias("target")),
                             F.struct(F.lit("down").alias("leg"), (F.col("m") - 12).alias("target"))))
    return J.nearest_strike(c, mid.select("chain_id", legs.alias("x")).select("chain_id", "x.leg", "x.target"))
