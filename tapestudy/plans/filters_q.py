"""Queries of filters and predicates (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import series as S
from .inputs import BARS, CALENDAR, EARNINGS, INTRADAY, VIX, bars, calendar, earnings, intraday, vix
from .registry import query
from .series_q import RETURNS


@query("B1_filter_period", "symbol d:s close:f",
       """SELECT symbol, d, close FROM bars WHERE d BETWEEN DATE '1996-03-15' AND DATE '1999-09-30'
          AND year(d) IN (1996, 1998) AND month(d) IN (1, 6, 9)""", [BARS])
def b1(spark, sf):
    return P.filter_period(bars(spark, sf), years=[1996, 1998], date_from="1996-03-15", date_to="1999-09-30", months=[1, 6, 9])


@query("B2_relative_period", "span n:i first_d:s last_d:s",
       """SELECT span, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM bars JOIN (VALUES
          ('18 months', DATE '1998-08-31' - INTERVAL 18 MONTH), ('6 weeks', DATE '1998-08-31' - INTERVAL 42 DAY),
          ('ytd', DATE '1998-01-01'), ('since 1997', DATE '1997-01-01')) AS p(span, lo)
          ON d >= lo AND d <= DATE '1998-08-31' GROUP BY span""", [BARS])
def b2(spark, sf):
    spans = {"18 months": (18, "months"), "6 weeks": (6, "weeks"), "ytd": (None, "ytd"), "since 1997": (1997, "since")}
    b = bars(spark, sf)
    tagged = F.array_compact(F.array(*[
        F.when(F.col("d").between(*P.relative_period(n, unit, "1998-08-31")), F.lit(name)) for name, (n, unit) in spans.items()]))
    return (b.select("d", F.explode(tagged).alias("span")).groupBy("span")
            .agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d")))


@query("B3_filter_calendar", "symbol d:s close:f",
       "SELECT symbol, d, close FROM bars WHERE isodow(d) = 1 AND quarter(d) IN (1, 4) AND year(d) = 1997", [BARS])
def b3(spark, sf):
    return P.filter_calendar(bars(spark, sf), year=1997, weekday=0, quarter=[1, 4])


@query("B4_threshold", "d:s close:f near:b mid:b",
       """SELECT d, close, abs(close - 25.0) <= 1e-8 + 1e-2 * 0 + 1e-5 * 25.0 AS near, close BETWEEN 20 AND 30 AS mid
          FROM vix WHERE close > 18""", [VIX])
def b4(spark, sf):
    return vix(spark, sf).filter(P.threshold("close", ">", 18.0)).withColumns(
        {"near": P.threshold("close", "=", 25.0), "mid": P.threshold("close", "between", 20.0, 30.0)})


@query("B5_boolean_filter", "symbol d:s var_pct:f",
       """SELECT symbol, d, var_pct FROM ret WHERE (coalesce(var_pct < -20, false) OR NOT coalesce(next_var > 0, false)) AND volume > 50""",
       [BARS, RETURNS])
def b5(spark, sf):
    tree = ("and", ("or", F.col("var_pct") < -20, ("not", F.col("next_var") > 0)), F.col("volume") > 50)
    return P.boolean_filter(S.returns(bars(spark, sf)), tree)


@query("B6_dates_where", "symbol d:s close:f",
       """SELECT symbol, d, close FROM bars WHERE d IN (SELECT d FROM vix WHERE close > 20)
          AND d IN (SELECT d FROM bars WHERE symbol = 'NO' AND close < open) AND isodow(d) = 2""", [BARS, VIX])
def b6(spark, sf):
    b = bars(spark, sf)
    high_vix = P.dates_where(vix(spark, sf), F.col("close") > 20)
    red = P.dates_where(b, (F.col("symbol") == "NO") & (F.col("close") < F.col("open")))
    return P.filter_calendar(P.restrict_to_dates(b, high_vix, red), weekday=1)


@query("B7_overnight_dates", "symbol d:s",
       "SELECT symbol, d FROM (SELECT symbol, d, open > lag(close) OVER (PARTITION BY symbol ORDER BY d) AS up FROM bars) AS b WHERE up", [BARS])
def b7(spark, sf):
    return P.overnight_dates(bars(spark, sf))


@query("B8_calendar_event_dates", "d:s",
       "SELECT DISTINCT d FROM calendar WHERE (lower(event) LIKE '%cpi%' OR lower(event) LIKE '%payrolls%') AND actual > estimate", [CALENDAR])
def b8(spark, sf):
    return P.calendar_event_dates(calendar(spark, sf), ["CPI", "payrolls"], "positive")


@query("B9_exclude_event_window", "symbol d:s close:f",
       """SELECT symbol, d, close FROM bars AS b WHERE NOT EXISTS (
          SELECT 1 FROM earnings AS e WHERE e.symbol = b.symbol AND abs(date_diff('day', e.d, b.d)) <= 5)""", [BARS, EARNINGS])
def b9(spark, sf):
    return P.exclude_event_window(bars(spark, sf), earnings(spark, sf))


@query("B10_ex_ante_mask_intraday", "symbol ts:s d:s minute_of_day:i open:f high:f low:f close:f volume:f full_candle:b",
       """SELECT symbol, ts, d, minute_of_day, open, CASE WHEN done THEN high END AS high, CASE WHEN done THEN low END AS low, CASE WHEN done THEN close END AS close, CASE WHEN done THEN volume END AS volume, done AS full_candle
          FROM (SELECT *, ts + INTERVAL 60 MINUTE <= TIMESTAMP '2024-01-15 13:30:00' AS done FROM intraday
                WHERE ts <= TIMESTAMP '2024-01-15 13:30:00') AS i""", [INTRADAY()])
def b10(spark, sf):
    return P.ex_ante_mask_intraday(intraday(spark, sf), "2024-01-15 13:30:00", 60)


@query("B11_ex_ante_mask_daily", "symbol d:s open:f high:f low:f close:f volume:f full_candle:b",
       """SELECT symbol, d, open, CASE WHEN d < DATE '1998-06-15' THEN high END AS high, CASE WHEN d < DATE '1998-06-15' THEN volume END AS volume, CASE WHEN d < DATE '1998-06-15' THEN low END AS low,
          CASE WHEN d < DATE '1998-06-15' THEN close END AS close, d < DATE '1998-06-15' AS full_candle
          FROM bars WHERE d <= DATE '1998-06-15'""", [BARS])
def b11(spark, sf):
    return P.ex_ante_mask_daily(bars(spark, sf), "1998-06-15")


@query("B12_session_filter", "symbol ts:s close:f morning:b",
       """SELECT symbol, ts, close, minute_of_day < 720 AS morning FROM intraday WHERE minute_of_day BETWEEN 570 AND 960""", [INTRADAY(30)])
def b12(spark, sf):
    regular = P.session_filter(intraday(spark, sf, 30))
    morning = P.time_window(regular, "09:30", "12:00", "left").select("symbol", "ts", F.lit(True).alias("morning"))
    return regular.join(morning, ["symbol", "ts"], "left").withColumn("morning", F.coalesce("morning", F.lit(False)))


@query("B13_value_range_pair", "symbol n_total:i n_j0:i n_j0_eval:i n_both:i mean_j1:f median_j1:f pct_j0:f pct_both:f",
       """SELECT symbol, count(*) AS n_total, count(*) FILTER (WHERE j0) AS n_j0, count(*) FILTER (WHERE j0 AND next_var IS NOT NULL) AS n_j0_eval,
          count(*) FILTER (WHERE j0 AND next_var BETWEEN 0 AND 100) AS n_both, avg(next_var) FILTER (WHERE j0) AS mean_j1,
          median(next_var) FILTER (WHERE j0) AS median_j1, count(*) FILTER (WHERE j0) * 100.0 / count(*) AS pct_j0,
          count(*) FILTER (WHERE j0 AND next_var BETWEEN 0 AND 100) * 100.0 / count(*) FILTER (WHERE j0 AND next_var IS NOT NULL) AS pct_both
          FROM (SELECT *, var_pct BETWEEN -50 AND -10 AS j0 FROM ret WHERE var_pct IS NOT NULL) AS r GROUP BY symbol""", [BARS, RETURNS])
def b13(spark, sf):
    return P.value_range_pair(bars(spark, sf), (-50.0, -10.0), (0.0, 100.0))[0]


@query("B13_value_range_rows", "symbol d:s close:f var_pct:f next_var:f",
       "SELECT symbol, d, close, var_pct, next_var FROM ret WHERE var_pct BETWEEN -50 AND -10 AND next_var BETWEEN 0 AND 100", [BARS, RETURNS])
def b13_rows(spark, sf):
    return P.value_range_pair(bars(spark, sf), (-50.0, -10.0), (0.0, 100.0))[1]


@query("B14_intraday_value_at", "symbol d:s value:f",
       "SELECT symbol, d, close AS value FROM intraday WHERE minute_of_day = 600 AND close >= 40", [INTRADAY()])
def b14(spark, sf):
    return P.intraday_value_at(intraday(spark, sf), "10:00", ">=", 40.0)
