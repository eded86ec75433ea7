"""Queries of intraday sessions (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import filters as P
from ..operators import sessions as G
from .inputs import INTRADAY, intraday, ticks
from .registry import query
from .series_q import roll

I30 = INTRADAY(30)
REG = "reg AS (SELECT * FROM intraday WHERE minute_of_day BETWEEN 570 AND 960)"
HS = "(SELECT unnest([30, 60, 90, 120, 150, 180, 240, 300, 390]) AS h)"


def i30(spark, sf):
    return intraday(spark, sf, 30)


@query("G1_resample", "symbol ts:s open:f high:f low:f close:f volume:f",
       """SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
          FROM intraday GROUP BY symbol, time_bucket(INTERVAL '4 hours', ts)""", [I30])
def g1(spark, sf):
    return B.resample(i30(spark, sf), "4 hours")


@query("G1_daily_from_intraday", "symbol d:s open:f high:f low:f close:f volume:f",
       """SELECT symbol, d, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM intraday GROUP BY symbol, d""", [I30])
def g1_daily(spark, sf):
    return B.resample(i30(spark, sf))


@query("G1_bars_from_ticks", "symbol ts:s d:s minute_of_day:i open:f high:f low:f close:f volume:f", "SELECT * FROM intraday", [INTRADAY(5)])
def g1_ticks(spark, sf):
    return B.intraday_bars(ticks(spark, sf), "5 minutes", order="seq")


@query("G2_session_bounds", "symbol d:s open_ts:s close_ts:s rows:i prev_close_ts:s prev_d:s",
       """SELECT *, lag(close_ts) OVER w AS prev_close_ts, lag(d) OVER w AS prev_d FROM (SELECT symbol, d, min(ts) AS open_ts, max(ts) AS close_ts, count(*) AS rows FROM intraday GROUP BY symbol, d) AS g
          WINDOW w AS (PARTITION BY symbol ORDER BY d)""", [I30])
def g2(spark, sf):
    return G.session_bounds(i30(spark, sf))


ATT = """att AS (SELECT i.*, b.o AS regular_open, b.c AS regular_close, CASE WHEN minute_of_day > b.c THEN n.nd ELSE i.d END AS session_d,
  minute_of_day BETWEEN b.o AND b.c AS is_regular, minute_of_day < b.o AS is_premarket, minute_of_day > b.c AS is_after_hours
  FROM intraday AS i JOIN (SELECT symbol, coalesce(min(minute_of_day) FILTER (WHERE minute_of_day BETWEEN 540 AND 630), min(minute_of_day)) AS o,
    coalesce(max(minute_of_day) FILTER (WHERE minute_of_day BETWEEN 900 AND 1020), max(minute_of_day)) AS c FROM intraday GROUP BY symbol) AS b ON i.symbol = b.symbol
  JOIN (SELECT symbol, d, lead(d) OVER (PARTITION BY symbol ORDER BY d) AS nd FROM (SELECT DISTINCT symbol, d FROM intraday) AS u) AS n ON n.symbol = i.symbol AND n.d = i.d)"""


@query("G3_attach_session", "symbol ts:s session_d:s regular_open:i regular_close:i is_regular:b is_premarket:b is_after_hours:b", "SELECT * FROM att", [I30, ATT])
def g3(spark, sf):
    return G.attach_session(i30(spark, sf))


ENTRIES = f"""entries AS (
  SELECT *, (price - entry_price) / entry_price * 100.0 AS ret_pct, abs((price - entry_price) / entry_price * 100.0) AS abs_ret_pct, abs(price - entry_price) AS abs_pts,
    abs((price - entry_price) / entry_price * 100.0) >= 20.0 AS big_move,
    CASE WHEN h >= 120 THEN greatest(abs(hi - entry_price), abs(lo - entry_price)) / entry_price * 100.0 <= 60.0 END AS calm
  FROM (SELECT e.symbol, e.d, e.entry_price, e.close_1600, (e.entry_price - e.prev) / e.prev * 100.0 AS gap_pct, x.h,
               arg_max(r.close, r.ts) AS price, max(r.high) AS hi, min(r.low) AS lo
        FROM (SELECT *, lag(close_1600) OVER (PARTITION BY symbol ORDER BY d) AS prev FROM (
                SELECT symbol, d, min(minute_of_day) FILTER (WHERE minute_of_day >= 600) AS at, arg_min(open, ts) FILTER (WHERE minute_of_day >= 600) AS entry_price,
                       coalesce(max(close) FILTER (WHERE minute_of_day = 960), arg_max(close, ts)) AS close_1600, count(*) AS n FROM reg GROUP BY symbol, d) AS a WHERE n >= 4 AND entry_price IS NOT NULL) AS e
        CROSS JOIN {HS} AS x JOIN reg AS r ON r.symbol = e.symbol AND r.d = e.d AND r.minute_of_day BETWEEN e.at AND e.at + x.h
        GROUP BY ALL) AS g)"""


def entries(spark, sf):
    return G.entry_sessions(i30(spark, sf), "10:00", big=20.0, calm=60.0, min_bars=4)


@query("G4_entry_sessions", "symbol d:s horizon:i entry_price:f gap_pct:f price:f ret_pct:f abs_ret_pct:f abs_pts:f big_move:b calm:b",
       "SELECT *, h AS horizon FROM entries", [I30, REG, ENTRIES])
def g4(spark, sf):
    return entries(spark, sf)


AMP = """SELECT symbol, h AS horizon, count(*) AS n, avg(abs_ret_pct) AS mean_pct, median(abs_ret_pct) AS median_pct, avg(abs_pts) AS mean_pts, avg(CAST(big_move AS INT)) * 100.0 AS big_pct,
          avg(CAST(calm AS INT)) * 100.0 AS calm_pct FROM entries GROUP BY symbol, h HAVING count(*) >= 10"""


@query("G5_amplitude_stats", "symbol horizon:i n:i mean_pct:f median_pct:f mean_pts:f big_pct:f calm_pct:f", AMP, [I30, REG, ENTRIES])
def g5(spark, sf):
    return G.amplitude_stats(entries(spark, sf))


@query("G6_horizon_rank", "symbol horizon:i mean_pct:f rank:i", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean_pct DESC, horizon) AS rank FROM ({AMP}) AS a", [I30, REG, ENTRIES])
def g6(spark, sf):
    return G.horizon_rank(entries(spark, sf))


NIGHT = """days AS (SELECT symbol, d, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM reg GROUP BY symbol, d),
night AS (SELECT n.*, s.d AS session_d FROM (SELECT *, CASE WHEN minute_of_day < 570 THEN d ELSE d + 1 END AS t FROM intraday WHERE {cond}) AS n
  ASOF JOIN days AS s ON n.symbol = s.symbol AND n.t <= s.d)"""
OVERNIGHT = """overnight AS (SELECT n.symbol, n.session_d AS d, (n.c - n.o) / n.o * 100.0 AS overnight_ret, (s.c - s.o) / s.o * 100.0 AS day_ret
  FROM (SELECT symbol, session_d, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM night GROUP BY symbol, session_d HAVING count(*) >= 2) AS n
  JOIN days AS s ON n.symbol = s.symbol AND n.session_d = s.d)"""
NIGHT16 = NIGHT.format(cond="minute_of_day > 960 OR minute_of_day < 570")


@query("G7_overnight_vs_day", "symbol d:s overnight_ret:f day_ret:f", "SELECT * FROM overnight", [I30, REG, NIGHT16, OVERNIGHT])
def g7(spark, sf):
    return G.overnight_vs_day(i30(spark, sf), i30(spark, sf))


@query("G7_overnight_correlation", "symbol n:i corr:f same_direction_pct:f mean_overnight:f",
       """SELECT symbol, count(*) AS n, corr(overnight_ret, day_ret) AS corr, avg(CASE WHEN (overnight_ret > 0) = (day_ret > 0) THEN 1.0 ELSE 0.0 END) * 100 AS same_direction_pct,
          avg(overnight_ret) AS mean_overnight FROM overnight GROUP BY symbol""", [I30, REG, NIGHT16, OVERNIGHT])
def g7_corr(spark, sf):
    return G.overnight_correlation(g7(spark, sf))


@query("G8_overnight_features", "symbol d:s n_bars:i ret_pct:f direction:i range_pct:f volume:f last_bar_ret:f first_half:f second_half:f accel:f",
       """SELECT symbol, sd AS d, n AS n_bars, (c - o) / o * 100.0 AS ret_pct, CASE WHEN c > o THEN 1 ELSE -1 END AS direction, (hi - lo) / nullif(lo, 0) * 100.0 AS range_pct, volume, (c - lo_open) / lo_open * 100.0 AS last_bar_ret,
          (mc - o) / o * 100.0 AS first_half, (c - mo) / mo * 100.0 AS second_half, (c - mo) / mo * 100.0 - (mc - o) / o * 100.0 AS accel FROM (
          SELECT symbol, sd, count(*) AS n, arg_min(open, ts) AS o, arg_max(close, ts) AS c, arg_max(open, ts) AS lo_open, max(high) AS hi, min(low) AS lo, sum(volume) AS volume,
                 max(close) FILTER (WHERE rn = k // 2) AS mc, max(open) FILTER (WHERE rn = k // 2 + 1) AS mo FROM (
            SELECT i.*, s.d AS sd, row_number() OVER (PARTITION BY i.symbol, s.d ORDER BY i.ts) AS rn, count(*) OVER (PARTITION BY i.symbol, s.d) AS k
            FROM intraday AS i JOIN (SELECT DISTINCT symbol, d FROM reg) AS s ON s.symbol = i.symbol AND i.d BETWEEN s.d - 3 AND s.d AND i.ts < s.d + INTERVAL 571 MINUTE
            WHERE i.minute_of_day > 960 OR i.minute_of_day <= 570) AS a GROUP BY symbol, sd HAVING count(*) >= 2) AS b""", [I30, REG])
def g8(spark, sf):
    b = i30(spark, sf)
    return G.overnight_features(b, P.session_filter(b))


@query("G9_bar_features_at", "symbol d:s b0930_open:f b0930_amp:f b0930_dir:i b0930_close_pos:f b1000_close:f b1000_dir:i cum_ret:f",
       """SELECT symbol, d, o1 AS b0930_open, abs((c1 - o1) / o1 * 100.0) AS b0930_amp, CASE WHEN c1 > o1 THEN 1 WHEN c1 IS NOT NULL THEN -1 END AS b0930_dir,
          CASE WHEN h1 > l1 THEN (c1 - l1) / (h1 - l1) END AS b0930_close_pos, c2 AS b1000_close, CASE WHEN c2 > o2 THEN 1 WHEN c2 IS NOT NULL THEN -1 END AS b1000_dir,
          CASE WHEN n >= 2 THEN (c - o) / o * 100.0 END AS cum_ret FROM (
          SELECT symbol, d, count(*) AS n, arg_min(open, ts) AS o, arg_max(close, ts) AS c, max(open) FILTER (WHERE minute_of_day = 570) AS o1, max(close) FILTER (WHERE minute_of_day = 570) AS c1,
          max(high) FILTER (WHERE minute_of_day = 570) AS h1, max(low) FILTER (WHERE minute_of_day = 570) AS l1, max(open) FILTER (WHERE minute_of_day = 600) AS o2, max(close) FILTER (WHERE minute_of_day = 600) AS c2
          FROM intraday WHERE minute_of_day BETWEEN 570 AND 600 GROUP BY symbol, d) AS g""", [I30])
def g9(spark, sf):
    return G.bar_features_at(i30(spark, sf))


@query("G10_opening_range", "symbol d:s or_points:f or_pct:f or_open:f or_ret_pct:f or_direction:i",
       """SELECT symbol, d, h - l AS or_points, (h - l) / o * 100.0 AS or_pct, o AS or_open, (c - o) / o * 100.0 AS or_ret_pct, CASE WHEN c > o THEN 1 ELSE -1 END AS or_direction FROM (
          SELECT symbol, d, max(high) AS h, min(low) AS l, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM intraday WHERE minute_of_day >= 570 AND minute_of_day < 690 GROUP BY symbol, d HAVING count(*) >= 2) AS g""", [I30])
def g10(spark, sf):
    return G.opening_range(i30(spark, sf), 120)


NIGHT18 = NIGHT.format(cond="minute_of_day >= 1080 OR minute_of_day < 570")


def zs(x):
    return f"({x} - {roll('avg', x, 20, 10)}) / nullif({roll('stddev_samp', x, 20, 10)}, 0)"


@query("G11_prior_day_intraday_features",
       "symbol d:s jm1_amplitude:f jm1_close_pos:f jm1_last30_ret:f jm1_first60_ret:f jm1_or30_range:f jm1_or30_ratio:f jm1_vol_ratio:f ov_ret:f ov_range:f ov_vol:f premkt_ret:f jm1_amplitude_z20:f ov_ret_z20:f close_top_third:i gap_up:i large_overnight:i",
       f"""SELECT *, {zs('jm1_amplitude')} AS jm1_amplitude_z20, {zs('ov_ret')} AS ov_ret_z20, CASE WHEN jm1_close_pos > 0.67 THEN 1 ELSE 0 END AS close_top_third, CASE WHEN ov_ret > 0.3 THEN 1 ELSE 0 END AS gap_up,
          CASE WHEN ov_range > CASE WHEN count(ov_range) OVER f >= 20 THEN quantile_cont(ov_range, 0.8) OVER f END THEN 1 ELSE 0 END AS large_overnight
          FROM (SELECT p.*, n.ov_ret, n.ov_range, n.ov_vol, n.premkt_ret FROM (
            SELECT symbol, d, lag(amplitude) OVER w AS jm1_amplitude, lag(close_pos) OVER w AS jm1_close_pos, lag(last30) OVER w AS jm1_last30_ret, lag(first60) OVER w AS jm1_first60_ret,
              lag(or30) OVER w AS jm1_or30_range, lag(or30 / nullif(amplitude, 0)) OVER w AS jm1_or30_ratio, lag(vr) OVER w AS jm1_vol_ratio
            FROM (SELECT symbol, d, CASE WHEN n >= 5 THEN (h - l) / o * 100.0 END AS amplitude, CASE WHEN n >= 5 THEN (c - l) / nullif(h - l, 0) END AS close_pos, CASE WHEN n >= 5 AND n30 >= 1 THEN (c30 - o30) / o30 * 100.0 END AS last30,
                    CASE WHEN n >= 5 AND n60 >= 2 THEN (c60 - o60) / o60 * 100.0 END AS first60, CASE WHEN n >= 5 AND nor >= 1 THEN (hor - lor) / o * 100.0 END AS or30, CASE WHEN n >= 5 THEN va / nullif(vm, 0) END AS vr
                  FROM (SELECT symbol, d, count(*) AS n, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c,
                          count(*) FILTER (WHERE minute_of_day >= 930) AS n30, arg_max(close, ts) FILTER (WHERE minute_of_day >= 930) AS c30, arg_min(open, ts) FILTER (WHERE minute_of_day >= 930) AS o30,
                          count(*) FILTER (WHERE minute_of_day <= 630) AS n60, arg_max(close, ts) FILTER (WHERE minute_of_day <= 630) AS c60, arg_min(open, ts) FILTER (WHERE minute_of_day <= 630) AS o60,
                          count(*) FILTER (WHERE minute_of_day < 600) AS nor, max(high) FILTER (WHERE minute_of_day < 600) AS hor, min(low) FILTER (WHERE minute_of_day < 600) AS lor,
                          sum(volume) FILTER (WHERE minute_of_day >= 780) AS va, sum(volume) FILTER (WHERE minute_of_day < 780) AS vm FROM reg GROUP BY symbol, d) AS a) AS b
            WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS p
          LEFT JOIN (SELECT symbol, session_d, CASE WHEN n >= 3 THEN (c - o) / o * 100.0 END AS ov_ret, CASE WHEN n >= 3 THEN (h - l) / o * 100.0 END AS ov_range, CASE WHEN n >= 3 THEN v END AS ov_vol,
                       CASE WHEN n >= 3 AND np >= 2 THEN (cp - op) / op * 100.0 END AS premkt_ret
                     FROM (SELECT symbol, session_d, count(*) AS n, arg_min(open, ts) AS o, arg_max(close, ts) AS c, max(high) AS h, min(low) AS l, sum(volume) AS v,
                             count(*) FILTER (WHERE d = session_d AND minute_of_day >= 450 AND minute_of_day < 570) AS np, arg_max(close, ts) FILTER (WHERE d = session_d AND minute_of_day >= 450 AND minute_of_day < 570) AS cp,
                             arg_min(open, ts) FILTER (WHERE d = session_d AND minute_of_day >= 450 AND minute_of_day < 570) AS op FROM night GROUP BY symbol, session_d) AS a) AS n
            ON n.symbol = p.symbol AND n.session_d = p.d) AS j
          WINDOW f AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", [I30, REG, NIGHT18])
def g11(spark, sf):
    return G.prior_day_intraday_features(i30(spark, sf), min_day=5, min_last30=1, min_first60=2, min_or30=1)


@query("G12_window_return", "symbol d:s var_pct:f",
       """SELECT symbol, d, (c - o) / o * 100.0 AS var_pct FROM (SELECT symbol, d, max(open) FILTER (WHERE minute_of_day = 570) AS o, max(close) FILTER (WHERE minute_of_day = 690) AS c FROM intraday GROUP BY symbol, d) AS g
          WHERE o IS NOT NULL AND c IS NOT NULL""", [I30])
def g12(spark, sf):
    return G.window_return(i30(spark, sf), 120)


@query("G12_session_targets", "symbol d:s ret_close:f ret_open_next:f ret_30min:f ret_120min:f",
       """SELECT a.symbol, a.d, (a.c - a.o) / a.o * 100.0 AS ret_close, (lead(a.o) OVER (PARTITION BY a.symbol ORDER BY a.d) - a.c) / a.c * 100.0 AS ret_open_next, (c30 - o930) / o930 * 100.0 AS ret_30min, (c120 - o930) / o930 * 100.0 AS ret_120min
          FROM (SELECT symbol, d, arg_min(open, ts) AS o, arg_max(close, ts) AS c, max(open) FILTER (WHERE minute_of_day = 570) AS o930, max(close) FILTER (WHERE minute_of_day = 600) AS c30, max(close) FILTER (WHERE minute_of_day = 690) AS c120
                FROM intraday GROUP BY symbol, d) AS a""", [I30])
def g12_targets(spark, sf):
    b = i30(spark, sf)
    return G.session_targets(B.resample(b), b)


@query("G13_horizon_return_from_open", "symbol d:s horizon_ret:f",
       """SELECT o.symbol, o.d, (n.close - o.open) / o.open AS horizon_ret FROM (SELECT symbol, d, min(minute_of_day) AS m, arg_min(open, ts) AS open FROM reg GROUP BY symbol, d) AS o
          LEFT JOIN LATERAL (SELECT r.close FROM reg AS r WHERE r.symbol = o.symbol AND r.d = o.d AND abs(r.minute_of_day - o.m - 60) <= 60 ORDER BY abs(r.minute_of_day - o.m - 60), r.ts LIMIT 1) AS n ON true""", [I30, REG])
def g13(spark, sf):
    return G.horizon_return_from_open(i30(spark, sf), 60)


@query("G14_time_of_day_edge", "symbol minute_of_day:i n:i mean:f positive_rate:f best:f worst:f rank:i",
       """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, positive_rate DESC, n DESC, minute_of_day) AS rank FROM (
          SELECT symbol, minute_of_day, count(*) AS n, avg(r) AS mean, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate, max(r) AS best, min(r) AS worst FROM (
            SELECT *, (lead(close, 2) OVER (PARTITION BY symbol ORDER BY ts) - close) / nullif(close, 0) AS r FROM intraday) AS a
          WHERE r IS NOT NULL AND close > open GROUP BY symbol, minute_of_day) AS g WHERE n >= 5""", [I30])
def g14(spark, sf):
    return G.time_of_day_edge(i30(spark, sf), 2, F.col("close") > F.col("open"))


@query("G15_opening_bucket_by_month", "symbol month:i mean_abs:f mean_signed:f n:i",
       """SELECT symbol, month(d) AS month, avg(abs(r)) AS mean_abs, avg(r) AS mean_signed, count(*) AS n FROM (
          SELECT symbol, d, (arg_max(close, ts) - arg_min(open, ts)) / nullif(arg_min(open, ts), 0) AS r FROM (SELECT *, min(ts) OVER (PARTITION BY symbol, d) AS f FROM intraday) AS a
          WHERE ts < f + INTERVAL 120 MINUTE GROUP BY symbol, d) AS g GROUP BY symbol, month(d)""", [I30])
def g15(spark, sf):
    return G.opening_bucket_by_month(i30(spark, sf), 120)


@query("G16_premarket_inside_prior_range", "symbol n_strict:i n_touch:i mode mean_open:f",
       """SELECT symbol, ns AS n_strict, nt AS n_touch, CASE WHEN ns > 0 THEN 'strict' ELSE 'touch' END AS mode, CASE WHEN ns > 0 THEN ms ELSE mt END AS mean_open FROM (
          SELECT symbol, count(*) FILTER (WHERE ph <= h1 AND pl >= l1) AS ns, count(*) FILTER (WHERE ph <= h1 + tol AND pl >= l1 - tol) AS nt, avg(open) FILTER (WHERE ph <= h1 AND pl >= l1) AS ms,
          avg(open) FILTER (WHERE ph <= h1 + tol AND pl >= l1 - tol) AS mt FROM (
            SELECT g.*, (h1 - l1) * 0.001 AS tol, t.open FROM (SELECT *, lag(h) OVER w AS h1, lag(l) OVER w AS l1 FROM (
              SELECT symbol, d, max(high) FILTER (WHERE is_premarket) AS ph, min(low) FILTER (WHERE is_premarket) AS pl, max(high) FILTER (WHERE is_regular) AS h, min(low) FILTER (WHERE is_regular) AS l FROM att GROUP BY symbol, d) AS a
              WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS g
            JOIN (SELECT d, arg_min(open, ts) AS open FROM intraday WHERE symbol = 'click' AND minute_of_day >= 570 GROUP BY d) AS t ON g.d = t.d) AS j GROUP BY symbol) AS k""", [I30, ATT])
def g16(spark, sf):
    b = i30(spark, sf)
    click = b.filter("symbol = 'click' AND minute_of_day >= 570").groupBy("d").agg(F.min_by("open", "ts").alias("open"))
    return G.premarket_inside_prior_range(b, click)


@query("G17_premarket_return", "symbol d:s ret:f value:f",
       "SELECT symbol, session_d AS d, (arg_max(close, ts) - arg_min(open, ts)) / arg_min(open, ts) AS ret, arg_max(close, ts) AS value FROM att WHERE is_premarket GROUP BY symbol, session_d", [I30, ATT])
def g17(spark, sf):
    return G.premarket_return(i30(spark, sf))


@query("G18_window_metric_given_condition", "symbol mean:f n:i",
       """SELECT symbol, avg(m) AS mean, count(*) AS n FROM (SELECT symbol, d, avg((close - open) / nullif(open, 0)) AS m FROM intraday WHERE minute_of_day BETWEEN 900 AND 960
          AND d IN (SELECT d FROM intraday WHERE symbol = 'view' GROUP BY d HAVING (arg_max(close, ts) - arg_min(open, ts)) / arg_min(open, ts) >= 0.0022) GROUP BY symbol, d) AS g GROUP BY symbol""", [I30])
def g18(spark, sf):
    b = i30(spark, sf)
    daily = B.resample(b)
    days = P.dates_where(daily, (F.col("symbol") == "view") & ((F.col("close") - F.col("open")) / F.col("open") >= 0.0022))
    return G.window_metric_given_condition(b, "15:00", "16:00", days)


@query("G19_point_in_time_next_day", "symbol d:s next_open:f next_close:f next_ret:f",
       """SELECT symbol, d, no AS next_open, nc AS next_close, (nc - no) / nullif(no, 0) AS next_ret FROM (SELECT symbol, d, lead(o) OVER w AS no, lead(c) OVER w AS nc FROM (
          SELECT symbol, d, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM intraday GROUP BY symbol, d) AS a WINDOW w AS (PARTITION BY symbol ORDER BY d)) AS b
          WHERE d IN (SELECT d FROM intraday WHERE symbol = 'purchase' AND minute_of_day = 540 AND close >= 30)""", [I30])
def g19(spark, sf):
    b = i30(spark, sf)
    days = P.intraday_value_at(b.filter("symbol = 'purchase'"), "09:00", ">=", 30.0)
    return G.point_in_time_next_day(days, B.resample(b))


@query("G20_conditional_session_stats", "symbol horizon:i n:i pct_positive:f mean:f median:f",
       """SELECT symbol, h AS horizon, count(*) AS n, avg(CASE WHEN ret_pct > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_positive, avg(ret_pct) AS mean, median(ret_pct) AS median FROM entries
          WHERE gap_pct > 0.5 GROUP BY symbol, h HAVING count(*) >= 5""", [I30, REG, ENTRIES])
def g20(spark, sf):
    return G.conditional_session_stats(entries(spark, sf), F.col("gap_pct") > 0.5)


@query("G21_opening_bar_features", "symbol d:s minute:i open:f high:f low:f close:f open_bar_ret:f open_bar_range:f open_bar_direction:i",
       """SELECT *, (close - open) / nullif(open, 0) AS open_bar_ret, (high - low) / nullif(open, 0) AS open_bar_range, CAST(sign(close - open) AS INT) AS open_bar_direction FROM (
          SELECT symbol, d, min(minute_of_day) AS minute, arg_min(open, ts) AS open, arg_min(high, ts) AS high, arg_min(low, ts) AS low, arg_min(close, ts) AS close FROM intraday GROUP BY symbol, d) AS g""", [I30])
def g21(spark, sf):
    return G.opening_bar_features(i30(spark, sf))
