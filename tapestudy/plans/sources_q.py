"""Queries of readers, normalisation, catalog and writers (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import readers as R
from ..sources.shared import shared_dir
from .inputs import BARS, CALENDAR, EARNINGS, MARKET, TICKS, VIX, bars, calendar, earnings, market, table, ticks, vix
from .registry import query


def comma(col):
    return F.replace(F.col(col).cast("string"), F.lit("."), F.lit(","))


@query("A1_read_bars", "symbol freq_min:i d:s open:f high:f low:f close:f volume:f",
       "SELECT symbol, 1440 AS freq_min, d, open, high, low, close, volume FROM bars", [BARS])
def a1(spark, sf):
    """Daily bars written as one text file tree per series, then read back as one table."""
    path = shared_dir(spark, "bars-csv")
    text = bars(spark, sf).select(F.col("d").cast("string").alias("time"), comma("open").alias("open"), comma("high").alias("high"),
                                  comma("low").alias("low"), comma("close").alias("close"), comma("volume").alias("volume"),
                                  F.concat("symbol", F.lit("_daily.csv")).alias("file"))
    text.write.partitionBy("file").option("header", True).option("sep", ";").csv(path)
    return R.read_bars(spark, path)


@query("A2_normalize_numeric", "o_orderkey:i plain:f locale:f broken:f",
       """SELECT o_orderkey, o_totalprice AS plain, o_totalprice AS locale,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS broken FROM orders""")
def a2(spark, sf):
    o = table(spark, sf, "orders")
    text = F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    grouped = F.concat(F.substring(text, 1, 1), F.lit("."), F.substring(text, 2, 50))
    raw = o.select("o_orderkey", F.concat(F.lit(" "), text, F.lit(" ")).alias("plain"),
                   grouped.alias("locale"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(text).alias("broken"))
    return R.normalize_numeric(R.normalize_numeric(raw, ["plain", "broken"]), ["locale"], locale_aware=True)


@query("A3_normalize_time", "o_orderkey:i ts:s",
       """SELECT o_orderkey, strftime(utc AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS ts
          FROM (SELECT o_orderkey, local, local AT TIME ZONE 'Europe/Paris' AS utc
                FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR + INTERVAL 90 MINUTE AS local
                      FROM orders WHERE o_orderstatus <> 'P') AS a) AS b
          WHERE utc AT TIME ZONE 'Europe/Paris' = local AND (utc + INTERVAL 1 HOUR) AT TIME ZONE 'Europe/Paris' <> local
            AND (utc - INTERVAL 1 HOUR) AT TIME ZONE 'Europe/Paris' <> local""")
def a3(spark, sf):
    o = table(spark, sf, "orders")
    local = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), "o_orderdate")
    text = F.when(F.col("o_orderstatus") == "P", "not a time").otherwise(F.concat(F.lit(" "), local.cast("string")))
    return R.normalize_time(o.select("o_orderkey", text.alias("time")), src_tz="Europe/Paris", offset_minutes=90)


@query("A4_read_calendar", "d:s event impact actual:f9 estimate:f9 opex earnings_top2 low_activity",
       "SELECT * FROM calendar", [CALENDAR])
def a4_calendar(spark, sf):
    path = shared_dir(spark, "calendar-csv")
    c = calendar(spark, sf)
    c.select(F.col("d").cast("string").alias("Date"), F.col("event").alias("Event"), F.upper("impact").alias("Impact"),
             comma("actual").alias("Actual"), comma("estimate").alias("Estimate"), F.col("opex").alias("Options Expiration"),
             F.col("earnings_top2").alias("Date earnings top2 companies"), F.col("low_activity").alias("Low Activity Period")
             ).write.option("header", True).option("sep", ";").csv(path)
    return R.read_calendar(spark, path)


@query("A4_read_earnings_events", "symbol d:s timing eps_actual:f9 eps_estimated:f9 surprise_pct:f4",
       "SELECT * FROM earnings", [EARNINGS])
def a4_events(spark, sf):
    path = shared_dir(spark, "earnings-csv")
    e = earnings(spark, sf)
    e.select(F.col("d").cast("string").alias("date"), "timing", "eps_actual", "eps_estimated", "surprise_pct",
             F.concat("symbol", F.lit(".csv")).alias("file")).write.partitionBy("file").option("header", True).option("sep", ";").csv(path)
    return R.read_earnings_events(spark, path)


@query("A5_profile_series", "symbol rows:i time_parse_rate:f ohlc_complete_rows:i ohlc_bad_rows:i duplicate_timestamps:i dominant_minutes:f unsorted_rows:i sorted_ok:b",
       """SELECT c.symbol, c.rows, 1.0 AS time_parse_rate, c.rows AS ohlc_complete_rows, c.bad AS ohlc_bad_rows,
                 c.rows - c.stamps AS duplicate_timestamps, g.gap AS dominant_minutes, s.unsorted AS unsorted_rows, s.unsorted = 0 AS sorted_ok
          FROM (SELECT symbol, count(*) AS rows, count(DISTINCT ts) AS stamps, count(*) FILTER (WHERE price < size) AS bad
                FROM tk GROUP BY symbol) AS c
          JOIN (SELECT symbol, gap FROM (
                  SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, gap) AS rn
                  FROM (SELECT symbol, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 60e6, 6) AS gap
                        FROM (SELECT DISTINCT symbol, ts FROM tk) AS u) AS g0 WHERE gap > 0 GROUP BY symbol, gap) AS g1 WHERE rn = 1) AS g
            ON c.symbol = g.symbol
          JOIN (SELECT symbol, count(*) FILTER (WHERE ts < prev) AS unsorted
                FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM tk) AS s0 GROUP BY symbol) AS s
            ON c.symbol = s.symbol""",
       [TICKS, "tk AS (SELECT symbol, date_trunc('minute', ts) AS ts, price, size, seq * 7919 % 10007 * 1000000 + seq AS seq FROM ticks)"])
def a5(spark, sf):
    """Ticks at minute resolution as bars whose low may be above the close; ingestion order is a scrambled id."""
    t = ticks(spark, sf)
    raw = t.select("symbol", F.window("ts", "1 minute")["start"].alias("ts"), F.col("price").alias("open"), F.col("price").alias("high"),
                   F.least("price", "size").alias("low"), F.greatest("price", "size").alias("close"),
                   (F.col("seq") * 7919 % 10007 * 1000000 + F.col("seq")).alias("seq"))
    return R.profile_series(raw, order="seq", order_chunk=1000000000)


@query("A6_series_catalog", "symbol rows:i first_d:s last_d:s days:i n_columns:i",
       """SELECT symbol, count(*) AS rows, min(d) AS first_d, max(d) AS last_d, count(DISTINCT d) AS days, 5 AS n_columns
          FROM bars GROUP BY symbol""", [BARS])
def a6(spark, sf):
    return R.series_catalog(bars(spark, sf), view="bars_daily").withColumn("n_columns", F.size("columns"))


@query("A7_select_market_series", "symbol rows:i compared_by",
       """SELECT symbol, rows, CASE WHEN symbol LIKE 'DXY%' THEN 'var_pct' ELSE 'close' END AS compared_by
          FROM (SELECT CASE symbol WHEN 'VIX' THEN 'VIX_daily' WHEN '1-URGENT' THEN 'DXY_daily' WHEN '2-HIGH' THEN 'option_chain'
                            WHEN '3-MEDIUM' THEN 'SPX_30min' WHEN '4-NOT SPECIFIED' THEN 'put_call_ratio' WHEN '5-LOW' THEN 'AAPL_daily' ELSE symbol END AS symbol,
                       count(*) AS rows
                FROM (SELECT symbol, d FROM vix UNION ALL SELECT series, d FROM market UNION ALL SELECT symbol, d FROM bars) AS u GROUP BY 1) AS c
          WHERE symbol IN ('VIX_daily', 'DXY_daily', 'put_call_ratio') AND rows >= 50""", [VIX, MARKET, BARS])
def a7(spark, sf):
    m = market(spark, sf).select(F.col("series").alias("symbol"), "d", F.col("value").alias("close"))
    everything = vix(spark, sf).select("symbol", "d", "close").unionByName(m).unionByName(bars(spark, sf).select("symbol", "d", "close"))
    names = {"VIX": "VIX_daily", "1-URGENT": "DXY_daily", "2-HIGH": "option_chain", "3-MEDIUM": "SPX_30min",
             "4-NOT SPECIFIED": "put_call_ratio", "5-LOW": "AAPL_daily"}
    named = everything.replace(names, subset=["symbol"])
    return R.select_market_series(R.series_catalog(named))


@query("A8_write_signals", "symbol d:s close:f volume:f", "SELECT symbol, d, close, volume FROM bars WHERE close > open", [BARS])
def a8(spark, sf):
    path = shared_dir(spark, "signals")
    R.write_signals(bars(spark, sf).filter("close > open"), path, key="symbol")
    return spark.read.parquet(path)


@query("A9_dedupe_series", "symbol d:s price:f",
       "SELECT symbol, CAST(ts AS DATE) AS d, arg_max(price, seq) AS price FROM ticks GROUP BY symbol, CAST(ts AS DATE)", [TICKS])
def a9(spark, sf):
    return B.dedupe_series(ticks(spark, sf), value="price", order="seq")
