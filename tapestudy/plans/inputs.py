"""Market-like inputs derived from the given tables, each with the same derivation as a SQL CTE.

bars       lineitem by (l_returnflag||l_linestatus, ship day): six symbols, OHLCV per day
vix        all orders by day, prices / 10000: one level series of the size of a volatility index
market     orders by (priority, day): five level series in long form
ticks      events: symbol = event_type
earnings   per symbol and quarter, the day of the largest order of the customers mapped to the symbol
calendar   orders by (day, priority) as economic events
universe   customers mapped to the six symbols: sector, cap, analysts
chains     lineitem by ship month and quantity: an option-chain-like table per month
feedback   events as an answer log
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bars import daily_bars, intraday_bars

# The symbols of the derived daily bars.
SYMBOLS = ["AF", "AO", "NF", "NO", "RF", "RO"]
SYMBOL_LIST_SQL = "['AF','AO','NF','NO','RF','RO']"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bar_ticks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"))


def bars(spark, sf_dir):
    return daily_bars(bar_ticks(spark, sf_dir), order="seq")


BARS = """bars AS (
  SELECT symbol, d, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(size) AS volume
  FROM (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS price,
               l_quantity AS size, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq FROM lineitem) AS t
  GROUP BY symbol, d)"""


def vix(spark, sf_dir):
    p = F.col("o_totalprice") / 10000.0
    k = F.col("o_orderkey")
    return (table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"))
            .agg(F.min_by(p, k).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"),
                 F.max_by(p, k).alias("close"))
            .select(F.lit("VIX").alias("symbol"), "d", "open", "high", "low", "close"))


VIX = """vix AS (
  SELECT 'VIX' AS symbol, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice / 10000.0, o_orderkey) AS open,
         max(o_totalprice / 10000.0) AS high, min(o_totalprice / 10000.0) AS low,
         arg_max(o_totalprice / 10000.0, o_orderkey) AS close
  FROM orders GROUP BY CAST(o_orderdate AS DATE))"""


def market(spark, sf_dir):
    p, k = F.col("o_totalprice") / 10000.0, F.col("o_orderkey")
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d"))
            .agg(F.max_by(p, k).alias("value")))


MARKET = """market AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d,
         arg_max(o_totalprice / 10000.0, o_orderkey) AS value
  FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))"""


def ticks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"),
        F.col("event_id").alias("seq"))


TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, value AS price, CAST(1 AS DOUBLE) AS size, event_id AS seq FROM events)"""


def intraday(spark, sf_dir, minutes=60):
    return intraday_bars(ticks(spark, sf_dir), f"{minutes} minutes", order="seq")


def INTRADAY(minutes=60):
    return f"""intraday AS (
  SELECT symbol, ts, CAST(ts AS DATE) AS d, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute_of_day,
         open, high, low, close, volume
  FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts,
               arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events GROUP BY 1, 2) AS b)"""


def earnings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(s) for s in SYMBOLS])
    p = F.col("o_totalprice")
    # price in cents and order key in one long: the aggregates below keep fixed-width buffers
    rank = F.round(p * 100).cast("bigint") * 10000000000 + F.col("o_orderkey")
    return (o.select(F.element_at(names, (F.col("o_custkey") % 6 + 1).cast("int")).alias("symbol"),
                     F.date_trunc("quarter", "o_orderdate").cast("date").alias("q"),
                     F.to_date("o_orderdate").alias("day"), p.alias("p"), "o_orderkey", rank.alias("rank"))
            .groupBy("symbol", "q")
            .agg(F.max_by("day", "rank").alias("d"),
                 F.max_by("o_orderkey", "rank").alias("k"),
                 (F.avg("p") / 100000.0).alias("eps_actual"),
                 ((F.min("p") + F.max("p")) / 200000.0).alias("eps_estimated"))
            .select("symbol", "d", F.element_at(F.array(F.lit("bmo"), F.lit("amc"), F.lit("during")),
                                                (F.col("k") % 3 + 1).cast("int")).alias("timing"),
                    "eps_actual", "eps_estimated",
                    ((F.col("eps_actual") - F.col("eps_estimated")) / F.col("eps_estimated") * 100.0).alias("surprise_pct")))


EARNINGS = f"""earnings AS (
  SELECT symbol, d, ['bmo','amc','during'][k % 3 + 1] AS timing, eps_actual, eps_estimated,
         (eps_actual - eps_estimated) / eps_estimated * 100.0 AS surprise_pct
  FROM (SELECT {SYMBOL_LIST_SQL}[o_custkey % 6 + 1] AS symbol, date_trunc('quarter', o_orderdate) AS q,
               arg_max(CAST(o_orderdate AS DATE), (o_totalprice, o_orderkey)) AS d,
               arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS k,
               avg(o_totalprice) / 100000.0 AS eps_actual,
               (min(o_totalprice) + max(o_totalprice)) / 200000.0 AS eps_estimated
        FROM orders GROUP BY 1, 2) AS e)"""


def calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    event = (F.when(pr == "1-URGENT", "FOMC Rate Decision").when(pr == "2-HIGH", "US CPI m/m")
             .when(pr == "3-MEDIUM", "US Non-Farm Payrolls").when(pr == "4-NOT SPECIFIED", "US GDP q/q")
             .otherwise("Core PCE Price Index"))
    top = F.max("o_totalprice")
    return (o.groupBy(F.to_date("o_orderdate").alias("d"), pr)
            .agg(F.when(top > 400000, "high").when(top > 200000, "medium").otherwise("low").alias("impact"),
                 (F.avg("o_totalprice") / 1000.0).alias("actual"),
                 ((F.min("o_totalprice") + top) / 2000.0).alias("estimate"),
                 F.when(F.count(F.lit(1)) >= 4, "monthly").alias("opex"),
                 F.when(top > 450000, "AAPL, MSFT").alias("earnings_top2"),
                 F.when(top < 60000, "holiday").alias("low_activity"))
            .select("d", event.alias("event"), "impact", "actual", "estimate", "opex", "earnings_top2", "low_activity"))


CALENDAR = """calendar AS (
  SELECT CAST(o_orderdate AS DATE) AS d,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'FOMC Rate Decision' WHEN '2-HIGH' THEN 'US CPI m/m'
              WHEN '3-MEDIUM' THEN 'US Non-Farm Payrolls' WHEN '4-NOT SPECIFIED' THEN 'US GDP q/q'
              ELSE 'Core PCE Price Index' END AS event,
         CASE WHEN max(o_totalprice) > 400000 THEN 'high' WHEN max(o_totalprice) > 200000 THEN 'medium' ELSE 'low' END AS impact,
         avg(o_totalprice) / 1000.0 AS actual,
         (min(o_totalprice) + max(o_totalprice)) / 2000.0 AS estimate,
         CASE WHEN count(*) >= 4 THEN 'monthly' END AS opex,
         CASE WHEN max(o_totalprice) > 450000 THEN 'AAPL, MSFT' END AS earnings_top2,
         CASE WHEN max(o_totalprice) < 60000 THEN 'holiday' END AS low_activity
  FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderpriority)"""


def universe(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in SYMBOLS])
    return (table(spark, sf_dir, "customer")
            .groupBy(F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int")).alias("symbol"))
            .agg(F.min("c_mktsegment").alias("sector"), F.round(F.sum("c_acctbal") / 1000.0, 1).alias("market_cap"),
                 F.count_distinct("c_nationkey").alias("n_analysts"),
                 F.round(F.avg("c_acctbal") / 2500.0, 2).alias("beta")))


UNIVERSE = f"""universe AS (
  SELECT {SYMBOL_LIST_SQL}[c_custkey % 6 + 1] AS symbol, min(c_mktsegment) AS sector,
         round(sum(c_acctbal) / 1000.0, 1) AS market_cap, count(DISTINCT c_nationkey) AS n_analysts,
         round(avg(c_acctbal) / 2500.0, 2) AS beta
  FROM customer GROUP BY 1)"""


def chains(spark, sf_dir):
    strike = F.col("l_quantity") * 5.0
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("chain_id"), strike.alias("strike"))
            .agg(F.round(F.avg("l_discount"), 4).alias("u"), F.round(F.avg("l_tax"), 4).alias("v"))
            .select("chain_id", "strike",
                    ((F.lit(255.0) - F.col("strike")) * 0.2 + F.col("u") * 10.0).alias("call_bid"),
                    ((F.lit(255.0) - F.col("strike")) * 0.2 + F.col("u") * 10.0 + F.col("v") + 0.1).alias("call_ask"),
                    (F.lit(1.0) - F.col("strike") / 255.0 + F.col("u") - 0.05).alias("call_delta"),
                    (F.col("strike") * 0.2 + F.col("u") * 8.0).alias("put_bid"),
                    (F.col("strike") * 0.2 + F.col("u") * 8.0 + F.col("v") + 0.1).alias("put_ask"),
                    (F.lit(0.0) - F.col("strike") / 255.0 - F.col("v")).alias("put_delta")))


CHAINS = """chains AS (
  SELECT chain_id, strike, (255.0 - strike) * 0.2 + u * 10.0 AS call_bid,
         (255.0 - strike) * 0.2 + u * 10.0 + v + 0.1 AS call_ask, 1.0 - strike / 255.0 + u - 0.05 AS call_delta,
         strike * 0.2 + u * 8.0 AS put_bid, strike * 0.2 + u * 8.0 + v + 0.1 AS put_ask,
         0.0 - strike / 255.0 - v AS put_delta
  FROM (SELECT strftime(l_shipdate, '%Y-%m') AS chain_id, l_quantity * CAST(5.0 AS DOUBLE) AS strike,
               round(avg(l_discount), 4) AS u, round(avg(l_tax), 4) AS v
        FROM lineitem GROUP BY 1, 2) AS c)"""


def feedback(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "ts", "event_id", F.when(t.isin("purchase", "signup"), "OK").when(t == "error", "FAUX").otherwise("PASSE").alias("label"),
        F.concat(F.lit("engine"), (F.col("user_id") % 3).cast("string")).alias("engine"),
        F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("app_version"))


FEEDBACK = """feedback AS (
  SELECT ts, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'OK' WHEN event_type = 'error' THEN 'FAUX'
         ELSE 'PASSE' END AS label, 'engine' || CAST(user_id % 3 AS VARCHAR) AS engine,
         'v' || CAST(user_id % 4 AS VARCHAR) AS app_version
  FROM events)"""


# Roles of the asset panel and where each comes from.
BAR_ROLES = {"AF": "spx", "AO": "iwm", "NF": "qqq", "NO": "gold", "RF": "dxy", "RO": "bonds10"}
PRIORITY_ROLES = {"1-URGENT": "vix", "2-HIGH": "vix9d", "3-MEDIUM": "vix3m", "4-NOT SPECIFIED": "vix6m", "5-LOW": "vvix"}
STATUS_ROLES = {"F": "nikkei", "O": "dax", "P": "skew"}
LINE_ROLES = {1: "spx_pc", 2: "vix_pc", 3: "equity_pc", 4: "iwm_pc", 5: "qqq_pc", 6: "ad", 7: "bonds30"}
ROLES = [*BAR_ROLES.values(), *PRIORITY_ROLES.values(), *STATUS_ROLES.values(), *LINE_ROLES.values()]


def assets(spark, sf_dir):
    """A long table (series, d, value) of 21 market-like series."""
    def role(col, names):
        return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[col]
    o = table(spark, sf_dir, "orders")
    day, p, k = F.to_date("o_orderdate").alias("d"), F.col("o_totalprice"), F.col("o_orderkey")
    status_scale = F.when(F.col("o_orderstatus") == "P", 3500.0).otherwise(100.0)
    lines = table(spark, sf_dir, "lineitem")
    parts = [
        bars(spark, sf_dir).select(role(F.col("symbol"), BAR_ROLES).alias("series"), "d", (F.col("close") / 1000.0).alias("value")),
        market(spark, sf_dir).select(role(F.col("series"), PRIORITY_ROLES).alias("series"), "d", "value"),
        o.groupBy(role(F.col("o_orderstatus"), STATUS_ROLES).alias("series"), day).agg(F.max_by(p / status_scale, k).alias("value")),
        lines.groupBy(role(F.col("l_linenumber"), LINE_ROLES).alias("series"), F.to_date("l_shipdate").alias("d")).agg(
            (F.round(F.avg("l_discount"), 6) * 10.0 + 0.5).alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _case(col, names):
    quoted = {(f"'{k}'" if isinstance(k, str) else k): v for k, v in names.items()}
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in quoted.items()) + " END"


ASSETS = f"""assets AS (
  SELECT {_case('symbol', BAR_ROLES)} AS series, d, close / 1000.0 AS value FROM bars
  UNION ALL SELECT {_case('series', PRIORITY_ROLES)}, d, value FROM market
  UNION ALL SELECT {_case('o_orderstatus', STATUS_ROLES)}, CAST(o_orderdate AS DATE),
    arg_max(o_totalprice / CASE WHEN o_orderstatus = 'P' THEN 3500.0 ELSE 100.0 END, o_orderkey) FROM orders GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)
  UNION ALL SELECT {_case('l_linenumber', LINE_ROLES)}, CAST(l_shipdate AS DATE), round(avg(l_discount), 6) * 10.0 + 0.5
    FROM lineitem GROUP BY l_linenumber, CAST(l_shipdate AS DATE))"""
