"""Calendar and feature families without look-ahead.

Two shapes are used. Families that treat every series alike (H4, H5, H8, H9) stay long: windows are partitioned by series.
Families that relate named series work on a *panel*: one row per (panel, session) with one column per role, whose windows
are partitioned by ``panel`` (a market or universe), so a group holds one row per session. Every input is the
previous session's value carried to the session (``lagged`` / ``panel``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    all_of, any_of, as_col, change, change_pct, contains_any, count_where, flag, plain_text, truth,
)
from ..functions.windows import (
    keys, rolling, rolling_correlation, rolling_percentile, rolling_rank_pct, rolling_z, sessions, whole,
)
from .joins import ffill_to_index

PANEL = ["panel"]

# Event names that mark a day, by kind.
KEY_EVENTS = {
    "fomc": ["FOMC Minutes", "FOMC Press Conference", "Federal Funds Rate", "Fed Interest Rate Decision", "Fed Funds"],
    "cpi": ["Inflation Rate YoY", "Core Inflation Rate YoY", "CPI"],
    "nfp": ["Non Farm Payrolls", "Nonfarm Payrolls", "NFP"],
    "gdp": ["GDP Growth Rate QoQ", "GDP Growth Rate YoY"],
    "pce": ["Core PCE Price Index", "PCE Price Index"],
    "jobs": ["Initial Jobless Claims", "Continuing Jobless Claims"],
    "ism": ["ISM Manufacturing PMI", "ISM Services PMI", "ISM Non-Manufacturing"],
}


def calendar_features(cal: DataFrame, key_events=None, *, d="d", by=()) -> DataFrame:
    """H1: per day: option expiry, high-impact and counts, key events among high-impact ones, top-2 earnings, low activity, and
    the summed surprise of key events (null unless some actual and some estimate is known)."""
    key_events = key_events or KEY_EVENTS
    high = truth(F.col("impact") == "high")
    key = high & truth(contains_any("event", [w for words in key_events.values() for w in words]))
    flags = [F.coalesce(F.bool_or(high & truth(contains_any("event", key_events[k]))), F.lit(False)).alias(f"is_{k}") for k in key_events]
    known = (F.count(F.when(key, F.col("actual"))) > 0) & (F.count(F.when(key, F.col("estimate"))) > 0)
    surprise = F.sum(F.when(key, F.coalesce("actual", F.lit(0.0)) - F.coalesce("estimate", F.lit(0.0))))
    return cal.groupBy(*keys(by), d).agg(
        (F.count("opex") > 0).alias("is_opex"), (count_where(high) > 0).alias("is_high_impact"), count_where(high).alias("n_high_events"),
        count_where(F.col("impact") == "medium").alias("n_medium_events"), (F.count("earnings_top2") > 0).alias("is_earnings_top2"),
        (F.count("low_activity") > 0).alias("is_low_activity"), *flags, F.when(known, surprise).alias("macro_surprise_raw"))


def calendar_day_flags(cal: DataFrame, *, d="d", event="event", quiet="low_activity", impact="impact", time="macro_time") -> DataFrame:
    """H1, older column names: macro, quiet, high-impact and has-time flags by non-blank text."""
    def filled(name):
        return F.coalesce(F.bool_or(F.trim(F.col(name)) != ""), F.lit(False)) if name in cal.columns else F.lit(False)
    return cal.groupBy(d).agg(filled(event).alias("is_macro_day"), filled(quiet).alias("is_quiet_day"),
                              F.coalesce(F.bool_or(plain_text(impact).rlike("high|fort|elev")), F.lit(False)).alias("is_high_impact_day"),
                              filled(time).alias("has_macro_time"))


def macro_surprise(days: DataFrame, window: int = 60, min_periods: int = 5, *, d="d", by="panel") -> DataFrame:
    """H2: the surprise as a rolling z-score."""
    return days.withColumn("macro_surprise", rolling_z("macro_surprise_raw", sessions(by, d), window, min_periods))


def days_to_since(days: DataFrame, flag_col: str, name: str, *, d="d", by="panel") -> DataFrame:
    """H3: calendar days to the next and since the last flagged day (0 on a flagged day)."""
    w = sessions(by, d)
    marked = F.when(F.col(flag_col), F.col(d))
    nxt = F.first(marked, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.last(marked, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumns({f"days_to_{name}": F.datediff(nxt, F.col(d)), f"days_since_{name}": F.datediff(F.col(d), last)})


def lagged(long: DataFrame, index: DataFrame, steps=(1,), *, by="series", d="d", value="value") -> DataFrame:
    """The values of earlier rows of each series on the days of ``index``: column ``value`` is J-1, ``lag{n}`` the n-th row back."""
    w = sessions(by, d)
    cols = {f"lag{n}" if n > 1 else "_l1": F.lag(value, n).over(w) for n in {1, *steps}}
    own = long.select(*keys(by), d, value).withColumns(cols).drop(value).withColumnRenamed("_l1", value)
    return ffill_to_index(own, index, by=by, d=d)


def dense(features: DataFrame, min_n: int, *, by="feature", value="value") -> DataFrame:
    """Only the features with at least ``min_n`` values."""
    return features.withColumn("_n", F.count(value).over(whole(by))).filter(F.col("_n") >= min_n).drop("_n")


def melt(df: DataFrame, ids, columns: dict) -> DataFrame:
    """Long rows (ids, feature, value) from a mapping of name columns/texts to value columns."""
    rows = F.array(*[F.struct(name.alias("feature"), F.col(c).cast("double").alias("value")) for c, name in columns.items()])
    return df.select(*ids, F.inline(rows))


def raw_lagged_features(long: DataFrame, index: DataFrame, min_n: int = 30, *, by="series", d="d") -> DataFrame:
    """H4: every series at J-1 as a feature, kept with at least ``min_n`` values."""
    return dense(lagged(long, index, by=by, d=d).select(F.col(by).alias("feature"), d, "value"), min_n)


def derived_features(long: DataFrame, index: DataFrame, min_raw: int = 50, min_n: int = 20, *, by="series", d="d", close=None) -> DataFrame:
    """H5: momentum, z-scores, percent rank and acceleration of every series, and for closes (``close`` is a condition on the series
    name) the distance to its moving averages and its volatility. Long result (feature, d, value)."""
    raw = dense(lagged(long, index, by=by, d=d), min_raw, by=by)
    w = sessions(by, d)
    v = F.col("value")
    is_close = F.lit(True) if close is None else close

    def over_mean(n):
        mean = rolling("mean", v, w, n, n // 2)
        return F.when(is_close, F.try_divide(v - mean, mean) * 100.0)

    cols = {f"mom{n}d": change_pct(v, F.lag(v, n).over(w)) for n in (1, 3, 5, 10, 20)}
    cols |= {f"z{n}": rolling_z(v, w, n, n // 2) for n in (20, 60)}
    cols |= {"pct252": rolling_rank_pct(v, w, 252, 60)} | {f"distma{n}": over_mean(n) for n in (20, 50)}
    out = raw.withColumns(cols)
    out = out.withColumns({"accel5": F.col("mom5d") - F.lag("mom5d", 5).over(w)} |
                          {f"vol{n}": F.when(is_close, rolling("std", "mom1d", w, n, n // 2)) for n in (5, 10, 20)})
    names = [*cols, "accel5", "vol5", "vol10", "vol20"]
    return dense(melt(out, [d], {c: F.concat(F.col(by), F.lit(f"_{c}")) for c in names}), min_n)


def lag_features(long: DataFrame, index: DataFrame, min_raw: int = 50, min_n: int = 30, *, by="series", d="d", close=None) -> DataFrame:
    """H8: explicit lags and lag differences, streak flags, moving-average crossings and breakouts of every series."""
    raw = dense(lagged(long, index, (2, 3, 5, 10), by=by, d=d), min_raw, by=by)
    w = sessions(by, d)
    v = F.col("value")
    is_close = F.lit(True) if close is None else close
    up = F.when(change(v, F.lag(v).over(w)) > 0, 1).otherwise(0)
    first = raw.withColumns({"_up": up, "_m5": v > rolling("mean", v, w, 5, 3), "_m20": v > rolling("mean", v, w, 20, 10)})
    lag = {"1": v} | {str(n): F.col(f"lag{n}") for n in (3, 5, 10)}
    cols = {f"diff_{a}_{b}": F.when(is_close, lag[str(a)] - lag[str(b)]) for a, b in ((1, 3), (1, 5), (3, 10), (5, 10))}
    for n in (2, 3, 5):
        run = rolling("sum", "_up", w, n)
        cols[f"streak_bull{n}"] = F.when(is_close, flag(run == n))
        cols[f"streak_bear{n}"] = F.when(is_close, flag(run == 0))
    for n in (5, 20):
        now, before = truth(f"_m{n}"), truth(F.lag(f"_m{n}").over(w))
        cols[f"cross_ma{n}_up"] = F.when(is_close, flag(now & ~before))
        cols[f"cross_ma{n}_down"] = F.when(is_close, flag(~now & before))
    for n in (5, 10, 20):
        cols[f"breakout_up{n}"] = F.when(is_close, flag(v >= rolling("max", v, w, n, n // 2)))
        cols[f"breakout_down{n}"] = F.when(is_close, flag(v <= rolling("min", v, w, n, n // 2)))
    out = first.withColumns(cols)
    return dense(melt(out, [d], {c: F.concat(F.col(by), F.lit(f"_{c}")) for c in ["lag2", "lag3", "lag5", "lag10", *cols]}), min_n)


def microstructure_features(bars: DataFrame, index: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """H9: candle geometry, gaps, true range, ATR and candle sequences of the previous session, one row per (symbol, session)."""
    w = sessions(symbol, d)
    own = bars.select(*keys(symbol), d, *[F.lag(c).over(w).alias(c) for c in ("open", "high", "low", "close", "volume")], F.lag("close", 2).over(w).alias("prev_close"))
    rows = ffill_to_index(own, index, by=symbol, d=d)
    o, h, l, c, p = (F.col(x) for x in ("open", "high", "low", "close", "prev_close"))
    span = F.nullif(h - l, F.lit(0.0))
    tr = F.greatest(h - l, F.abs(h - p), F.abs(l - p))
    gap = change_pct(o, p)
    ratio = F.try_divide(F.abs(c - o), span)
    out = rows.withColumns({"_tr": tr, "_bull": F.when(c > o, 1).otherwise(0), "_bear": F.when(c < o, 1).otherwise(0)})
    cols = {
        "body_pct": F.try_divide(F.abs(c - o), o) * 100.0, "body_dir": F.signum(c - o),
        "upper_shadow": F.greatest(F.try_divide(h - F.greatest(o, c), h) * 100.0, F.lit(0.0)),
        "lower_shadow": F.greatest(F.try_divide(F.least(o, c) - l, F.least(o, c)) * 100.0, F.lit(0.0)),
        "close_position": F.try_divide(c - l, span), "gap_pct": gap, "gap_up": flag(gap > 0.1), "gap_down": flag(gap < -0.1),
        "true_range": F.try_divide(F.col("_tr"), p) * 100.0, "body_ratio": ratio, "is_doji": flag(ratio < 0.1), "effort_result": span * F.col("volume") / 1e6}
    cols |= {f"atr{n}": F.try_divide(rolling("mean", "_tr", w, n, n // 2), p) * 100.0 for n in (5, 14)}
    for n in (2, 3):
        cols[f"bull_candles{n}"] = flag(rolling("sum", "_bull", w, n) == n)
        cols[f"bear_candles{n}"] = flag(rolling("sum", "_bear", w, n) == n)
    return out.select(*keys(symbol), d, *[v.alias(k) for k, v in cols.items()])


def panel(long: DataFrame, roles, index: DataFrame, name: str = "market", *, by="series", d="d", value="value") -> DataFrame:
    """One row per session with the previous session's value of each role. ``roles`` is a list of series names or a mapping of role
    to series name; roles without data stay null. ``long`` may carry a ``panel`` column to build several panels at once."""
    roles = roles if isinstance(roles, dict) else {r: r for r in roles}
    group = [*PANEL, by] if "panel" in long.columns else [by]
    src = long.filter(F.col(by).isin(list(roles.values())))
    rows = lagged(src, index, by=group, d=d, value=value)
    if "panel" not in long.columns:
        rows = rows.withColumn("panel", F.lit(name))
    wide = rows.groupBy("panel", d).pivot(by, sorted(set(roles.values()))).agg(F.max(value))
    return wide.select("panel", d, *[F.col(f"`{s}`").alias(r) for r, s in roles.items()])


class Rolling:
    """Column builders over a panel's session window. Inputs are columns that exist already (windows do not nest)."""

    def __init__(self, d="d"):
        self.w = sessions(PANEL, d)

    def lag(self, c, n=1):
        return F.lag(as_col(c), n).over(self.w)

    def mom(self, c, n=1):
        return change_pct(c, self.lag(c, n))

    def mean(self, c, n, m=None):
        return rolling("mean", c, self.w, n, m)

    def std(self, c, n, m=None):
        return rolling("std", c, self.w, n, m)

    def z(self, c, n, m=None):
        return rolling_z(c, self.w, n, m)

    def zh(self, c, n):
        """z-score that accepts half-filled windows."""
        return rolling_z(c, self.w, n, n // 2)

    def q(self, c, n, q, m=None):
        return rolling_percentile(c, q, self.w, n, m)

    def rank(self, c, n=252, m=None):
        return rolling_rank_pct(c, self.w, n, m or n // 3)

    def corr(self, a, b, n):
        return rolling_correlation(a, b, self.w, n)

    def high(self, c, n, m):
        return rolling("max", c, self.w, n, m)


def safe_ratio(a, b, min_abs: float = 0.01) -> Column:
    """a / b, null while b is within ``min_abs`` of zero."""
    b = as_col(b)
    return as_col(a) / F.when(F.abs(b) > min_abs, b)


def row_mean(cols) -> Column:
    """Mean of the non-null columns of a row."""
    cols = [as_col(c) for c in cols]
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols]), n)


def row_std(cols) -> Column:
    """Sample deviation of the non-null columns of a row."""
    cols = [as_col(c) for c in cols]
    mean = row_mean(cols)
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    squares = reduce(lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols])
    return F.when(n >= 2, F.sqrt(squares / (n - 1)))


# The pairs of the cross features.
RATIO_PAIRS = [("vix", "vix3m"), ("vix9d", "vix"), ("vix9d", "vix3m"), ("vix", "vix6m"), ("vvix", "vix"), ("vix1d_vix_ratio", "vix"), ("skew", "vix"),
               ("dxy", "gold"), ("spx", "qqq"), ("spx", "iwm"), ("spx_pc", "equity_pc"), ("vix_pc", "spx_pc")]
SPREAD_PAIRS = [("vix9d", "vix"), ("vix3m", "vix"), ("vix6m", "vix3m")]
CORR_PAIRS = [("spx", "gold"), ("spx", "dxy"), ("spx", "bonds10"), ("vix", "spx"), ("gold", "dxy")]
PRODUCT_PAIRS = [("vix", "skew"), ("vvix", "vix9d")]


def present(p: DataFrame, pairs):
    return [(a, b) for a, b, *_ in pairs if a in p.columns and b in p.columns]


def cross_features(p: DataFrame, *, d="d") -> DataFrame:
    """H6: ratios, spreads and products with their z-scores, rolling correlations of daily changes, relative 5-day moves."""
    R = Rolling(d)
    base = {f"ratio_{a}_{b}": F.try_divide(F.col(a), F.col(b)) for a, b in present(p, RATIO_PAIRS)}
    base |= {f"spread_{a}_{b}": F.col(a) - F.col(b) for a, b in present(p, SPREAD_PAIRS)}
    base |= {f"interact_{a}_{b}": F.col(a) * F.col(b) for a, b in present(p, PRODUCT_PAIRS)}
    pairs = present(p, CORR_PAIRS)
    moved = sorted({x for pair in pairs for x in pair})
    out = p.withColumns(base | {f"_r_{x}": R.mom(x) for x in moved})
    cols = {f"{k}_z20": R.z(k, 20) for k in base}
    cols |= {f"corr_{a}_{b}_{n}d": R.corr(f"_r_{a}", f"_r_{b}", n) for a, b in pairs for n in (10, 20)}
    cols |= {f"spx_vs_{x}_5d": R.mom("spx", 5) - R.mom(x, 5) for x in ("iwm", "qqq") if x in p.columns and "spx" in p.columns}
    out = out.withColumns(cols)
    return out.select("panel", d, *base, *cols)


def temporal_features(p: DataFrame, *, d="d") -> DataFrame:
    """H7: calendar numbers, the index against its moving averages, its streak and volatility, and level regimes of the volatility index."""
    R = Rolling(d)
    day = {"day_of_week": F.weekday(d), "month": F.month(d), "week_of_year": F.weekofyear(d), "day_of_month": F.dayofmonth(d), "is_monday": flag(F.weekday(d) == 0),
           "is_friday": flag(F.weekday(d) == 4), "is_month_start": flag(F.dayofmonth(d) <= 5), "is_month_end": flag(F.dayofmonth(d) >= 25)}
    spx, vix = F.col("spx"), F.col("vix")
    out = p.withColumns({"_r": change(spx, R.lag("spx")), "_n": F.row_number().over(R.w)})
    out = out.withColumn("_up", truth(F.col("_r") > 0))
    seen = R.w.rowsBetween(Window.unboundedPreceding, 0)
    start_up = F.coalesce(F.last(F.when(~F.col("_up"), F.col("_n")), True).over(seen), F.lit(0))
    start_down = F.coalesce(F.last(F.when(F.col("_up"), F.col("_n")), True).over(seen), F.lit(0))
    cols = {}
    for n in (5, 20, 60):
        mean = R.mean("spx", n, n // 2)
        cols[f"spx_above_ma{n}"] = flag(spx > mean)
        cols[f"spx_dist_ma{n}_pct"] = change_pct(spx, mean)
    cols["spx_streak"] = F.when(F.col("_up"), F.col("_n") - start_up).otherwise(start_down - F.col("_n"))
    cols |= {f"spx_rvol_{n}d": R.std("_r", n, n // 2) * 100.0 for n in (5, 20)}
    cols |= {"vix_regime_low": flag(vix < 15), "vix_regime_normal": flag((vix >= 15) & (vix < 20)), "vix_regime_high": flag((vix >= 20) & (vix < 30)),
             "vix_regime_crisis": flag(vix >= 30), "vix_mom1d": R.mom("vix"), "vix_mom5d": R.mom("vix", 5), "vix_spike": flag(vix > R.lag("vix") * 1.10),
             "vix_crush": flag(vix < R.lag("vix") * 0.90)}
    out = out.withColumns(cols)
    return out.select("panel", d, *[v.alias(k) for k, v in day.items()], *cols)


def lag_interactions(p: DataFrame, *, d="d") -> DataFrame:
    """H8: products across series: volatility level with index momentum, rising volatility with a falling index, skew with volatility
    momentum (three sessions)."""
    R = Rolling(d)
    vix, spx = F.col("vix"), F.col("spx")
    cols = {"vix_j1_x_spx_m5": vix * R.mom("spx", 5), "vix_j1_x_spx_m10": vix * R.mom("spx", 10),
            "vix_up3_and_spx_dn3": flag(vix > R.lag("vix", 3)) * flag(spx < R.lag("spx", 3)), "skew_j1_x_vix_m3": F.col("skew") * R.mom("vix", 3)}
    return p.select("panel", d, *[v.alias(k) for k, v in cols.items()])


def regime_transitions(p: DataFrame, *, d="d") -> DataFrame:
    """Level crossings, compression and extremes of the volatility index, drawdown and momentum regimes of the index, inversion of the
    term structure, vol-of-vol, skew and breadth crossings."""
    R = Rolling(d)
    vix, spx, vvix, skew, ad = (F.col(x) for x in ("vix", "spx", "vvix", "skew", "ad"))
    pv, pvv, psk, pad = R.lag("vix"), R.lag("vvix"), R.lag("skew"), R.lag("ad")
    out = p.withColumns({"_spread": F.col("vix9d") - vix, "spx_dist_ath_pct": change_pct(spx, R.high("spx", 252, 60)), "vix_zscore_20": R.z("vix", 20),
                         "_vvix_ma": R.mean("vvix", 20), "_ad_ma": R.mean("ad", 10), "_vol5": R.std("vix", 5), "_vol20": R.std("vix", 20)})
    dd, spread, before = F.col("spx_dist_ath_pct"), F.col("_spread"), R.lag("_spread")
    cols = {}
    for level in (15, 18, 20, 25, 30):
        cols[f"vix_cross_above_{level}"] = flag((vix >= level) & (pv < level))
        cols[f"vix_cross_below_{level}"] = flag((vix < level) & (pv >= level))
    cols |= {"vix_compression": flag(F.col("_vol5") < F.col("_vol20") * 0.5), "vix_expansion": flag(F.col("_vol5") > F.col("_vol20") * 1.5)}
    if "vix_open" in p.columns and "vix_high" in p.columns:
        cols["vix_spike_day"] = flag(change(F.col("vix_high"), F.col("vix_open")) > 0.05)
    cols |= {"vix_extreme_high": flag(F.col("vix_zscore_20") > 2.0), "vix_extreme_low": flag(F.col("vix_zscore_20") < -1.5),
             "spx_in_drawdown_5pct": flag(dd < -5), "spx_in_drawdown_10pct": flag(dd < -10), "spx_recovering": flag((dd > R.lag(dd, 5)) & (dd < -3))}
    for n, limit in ((5, 2.0), (20, 5.0), (60, 10.0)):
        cols[f"spx_strong_bull_{n}d"] = flag(R.mom("spx", n) > limit)
        cols[f"spx_strong_bear_{n}d"] = flag(R.mom("spx", n) < -limit)
    cols |= {"vix_ts_inverted": flag(spread > 0), "vix_ts_deeply_inverted": flag(spread > 2), "vix_ts_inversion_new": flag((spread > 0) & (before <= 0)),
             "vix_ts_normalization_new": flag((spread <= 0) & (before > 0)), "vix_ts_spread_accel": spread - R.lag(spread, 3)}
    cols |= {"vvix_above_ma20": flag(vvix > F.col("_vvix_ma")), "vvix_cross_above_ma20": flag((vvix > F.col("_vvix_ma")) & (pvv <= R.lag("_vvix_ma"))),
             "vvix_spike_3d": flag(vvix > F.col("_vvix_ma") + R.std("vvix", 20) * 2)}
    cols |= {f"skew_above_{n}": flag(skew > n) for n in (130, 140)} | {
        "skew_extreme": flag(skew > 150), "skew_above_ma20": flag(skew > R.mean("skew", 20)), "skew_cross_130_up": flag((skew > 130) & (psk <= 130)),
        "skew_cross_130_down": flag((skew < 130) & (psk >= 130))}
    cols |= {"ad_above_ma10": flag(ad > F.col("_ad_ma")), "ad_cross_ma10_up": flag((ad > F.col("_ad_ma")) & (pad <= R.lag("_ad_ma"))),
             "ad_cross_ma10_down": flag((ad < F.col("_ad_ma")) & (pad >= R.lag("_ad_ma"))), "ad_strong_bull_5d": flag(R.mom("ad", 5) > 5),
             "ad_strong_bear_5d": flag(R.mom("ad", 5) < -5)}
    out = out.withColumns(cols)
    return out.select("panel", d, "vix_zscore_20", "spx_dist_ath_pct", *cols)


# The put/call series of the sentiment features.
PUT_CALL = ["spx_pc", "vix_pc", "equity_pc", "iwm_pc", "qqq_pc"]


def put_call_sentiment(p: DataFrame, *, d="d") -> DataFrame:
    """Fear and greed flags at the yearly 90 and 10 % quantiles, momentum, z-scores and trend of each put/call series, ratios between them,
    the composite of their 60-session z-scores, and implied-volatility columns above their yearly 80 % quantile."""
    R = Rolling(d)
    cols, have = {}, [a for a in PUT_CALL if a in p.columns]
    for a in have:
        c = F.col(a)
        cols[f"{a}_extreme_fear"] = flag(c > R.q(a, 252, 0.90, 60))
        cols[f"{a}_extreme_greed"] = flag(c < R.q(a, 252, 0.10, 60))
        cols |= {f"{a}_mom{n}d": R.mom(a, n) for n in (1, 3, 5, 10)}
        cols |= {f"{a}_z20": R.z(a, 20), f"{a}_z60": R.z(a, 60), f"{a}_trending_fear": flag(c > R.mean(a, 5))}
    if {"spx_pc", "equity_pc"} <= set(have):
        cols["spx_vs_equity_pc_ratio"] = F.try_divide(F.col("spx_pc"), F.col("equity_pc"))
    if {"spx_pc", "vix_pc"} <= set(have):
        cols["vix_vs_spx_pc_ratio"] = F.try_divide(F.col("vix_pc"), F.col("spx_pc"))
    for a in ("iv_rank", "iv_percentile", "williams_vix_fix"):
        if a in p.columns:
            cols[f"spx_{a}_level"] = F.col(a)
            cols[f"spx_{a}_high"] = flag(F.col(a) > R.q(a, 252, 0.80, 60))
    out = p.withColumns(cols)
    late = {}
    if "spx_vs_equity_pc_ratio" in cols:
        late["spx_vs_equity_pc_z20"] = R.z("spx_vs_equity_pc_ratio", 20)
    if len(have) >= 3:
        late["composite_fear_index"] = row_mean([f"{a}_z60" for a in have])
    out = out.withColumns(late)
    if len(have) >= 3:
        extremes = {"composite_fear_extreme": flag(F.col("composite_fear_index") > 1.5), "composite_greed_extreme": flag(F.col("composite_fear_index") < -1.5)}
        out, late = out.withColumns(extremes), late | extremes
    return out.select("panel", d, *cols, *late)


def intermarket(p: DataFrame, *, d="d") -> DataFrame:
    """Overnight leaders, risk-on composite, rotations, rolling correlations, dollar and gold levels, slope of the yield curve."""
    R = Rolling(d)
    assets = ["spx", "nikkei", "dax", "gold", "dxy", "bonds10", "iwm", "qqq"]
    out = p.withColumns({f"_{a}": R.mom(a) for a in assets} | {"_slope": F.col("bonds30") - F.col("bonds10"), "gold_dist_ath": change_pct("gold", R.high("gold", 252, 60))})
    spx, nikkei, dax, gold, dxy, bonds, iwm, qqq = (F.col(f"_{a}") for a in assets)
    composite = (flag(spx > 0) + flag(gold < 0) + flag(dxy < 0) + flag(bonds > 0)) / 4.0
    slope5 = R.mom("_slope", 5)
    cols = {
        "nikkei_lead_spx": nikkei, "nikkei_vs_spx_diverge": nikkei - spx, "nikkei_strong_bull": flag(nikkei > 1.5), "nikkei_strong_bear": flag(nikkei < -1.5),
        "dax_lead_spx": dax, "dax_vs_spx_diverge": dax - spx, "gold_safe_haven": flag(gold > 1.0), "dxy_safe_haven": flag(dxy > 0.5),
        "risk_on_composite": composite, "risk_on_strong": flag(composite > 0.75), "risk_off_strong": flag(composite < 0.25),
        "small_vs_large_rotation": iwm - qqq, "risk_appetite_rotation": flag(iwm > qqq), "tech_vs_market": qqq - spx, "bonds_vs_spx_rotate": bonds - spx,
        "bonds_up_spx_down": flag((bonds > 0) & (spx < 0))}
    for n in (5, 10, 20):
        cols[f"spx_gold_corr_{n}d"] = R.corr("_spx", "_gold", n)
        cols[f"spx_gold_anticorr_{n}d"] = flag(cols[f"spx_gold_corr_{n}d"] < -0.5)
    cols |= {f"spx_dxy_corr_{n}d": R.corr("_spx", "_dxy", n) for n in (10, 20)}
    cols |= {"dxy_above_ma20": flag(F.col("dxy") > R.mean("dxy", 20)), "dxy_above_100": flag(F.col("dxy") > 100), "dxy_above_105": flag(F.col("dxy") > 105),
             "dxy_mom5d": R.mom("dxy", 5), "dxy_mom20d": R.mom("dxy", 20), "gold_above_ma20": flag(F.col("gold") > R.mean("gold", 20)),
             "gold_near_ath": flag(F.col("gold_dist_ath") > -3), "gold_mom5d": R.mom("gold", 5), "gold_mom20d": R.mom("gold", 20),
             "yield_curve_proxy": F.col("_slope"), "yield_curve_inverted": flag(F.col("_slope") < 0), "yield_curve_steepening": flag(slope5 > 2),
             "yield_curve_flattening": flag(slope5 < -2)}
    return out.select("panel", d, "gold_dist_ath", *[v.alias(k) for k, v in cols.items()])


# Pairs of the volatility term structure with their priority.
VOL_PAIRS = [("vix9d", "vix", 3), ("vix9d", "vix3m", 3), ("vix9d", "vix6m", 2), ("vix", "vix3m", 3), ("vix", "vix6m", 2), ("vix3m", "vix6m", 2)]


def vol_term_structure(p: DataFrame, *, d="d") -> DataFrame:
    """Ratios, spreads, z-scores, acceleration and inversion along the volatility term structure, vol-of-vol and skew ratios,
    and a composite stress figure."""
    R = Rolling(d)
    pairs = present(p, VOL_PAIRS)
    base = {}
    for a, b in pairs:
        base[f"vts_{a}_{b}_ratio"] = safe_ratio(a, b)
        base[f"vts_{a}_{b}_spread"] = F.col(a) - F.col(b)
    base |= {"vts_vvix_vix_ratio": safe_ratio("vvix", "vix"), "vts_skew_vix_ratio": safe_ratio("skew", "vix")}
    out = p.withColumns(base).withColumns({f"vts_{a}_{b}_inverted": flag(F.col(f"vts_{a}_{b}_ratio") > 1) for a, b in pairs})
    out = out.withColumns({"_z_vix": R.zh("vix", 20), "_z_spread": R.zh("vts_vix9d_vix_spread", 20), "_z_vvix": R.zh("vvix", 20), "_z_skew": R.zh("skew", 60)})
    cols = {}
    for a, b in pairs:
        k = f"vts_{a}_{b}"
        cols |= {f"{k}_ratio_z{n}": R.zh(f"{k}_ratio", n) for n in (20, 60)}
        cols[f"{k}_spread_accel3"] = F.col(f"{k}_spread") - R.lag(f"{k}_spread", 3)
        cols[f"{k}_inversion_new"] = flag((F.col(f"{k}_inverted") == 1) & (R.lag(f"{k}_inverted") == 0))
    cols |= {"vts_vvix_vix_ratio_z20": R.zh("vts_vvix_vix_ratio", 20), "vts_vvix_high": flag(F.col("vvix") > R.mean("vvix", 20) + R.std("vvix", 20) * 1.5),
             "vts_skew_vix_ratio_z20": R.zh("vts_skew_vix_ratio", 20), "vts_skew_high_vix_low": flag((F.col("skew") > 130) & (F.col("vix") < 18)),
             "vts_skew_down_vix_up": flag((R.mom("skew", 3) < -3) & (R.mom("vix", 3) > 5))}
    stress = row_mean(["_z_vix", "_z_spread", "_z_vvix", "_z_skew"])
    cols |= {"vts_composite_stress": stress, "vts_composite_stress_extreme": flag(stress > 2.0), "vts_composite_stress_low": flag(stress < -1.0)}
    out = out.withColumns(cols)
    return out.select("panel", d, *base, *[f"vts_{a}_{b}_inverted" for a, b in pairs], *cols)


def momentum_divergence(p: DataFrame, *, d="d") -> DataFrame:
    """Differences of momentum between related series over several windows with z-scores, lead and lag flags, stock/bond correlation,
    and the dispersion of three indices with its 80 % quantile flag."""
    R = Rolling(d)
    need = {"spx": (1, 3, 5), "iwm": (1, 3, 5), "qqq": (1, 3, 5), "gold": (1, 5), "dax": (1,), "nikkei": (1,), "bonds10": (1,)}
    out = p.withColumns({f"_{a}{n}": R.mom(a, n) for a, ns in need.items() for n in ns})
    m = lambda a, n=1: F.col(f"_{a}{n}")
    base = {f"div_spx_iwm_{n}d": m("spx", n) - m("iwm", n) for n in (1, 3, 5)}
    base |= {f"div_qqq_spx_{n}d": m("qqq", n) - m("spx", n) for n in (1, 3, 5)}
    base |= {f"div_spx_gold_{n}d": m("spx", n) - m("gold", n) for n in (1, 5)}
    base |= {"div_spx_dax_1d": m("spx") - m("dax"), "div_nikkei_spx_1d": m("nikkei") - m("spx"), "div_triple_dispersion": row_std([m("spx"), m("iwm"), m("qqq")]),
             "div_spx_bonds10_corr10d": R.corr(m("spx"), m("bonds10"), 10), "div_spx_bonds10_corr20d": R.corr(m("spx"), m("bonds10"), 20)}
    out = out.withColumns(base)
    cols = {f"{k}_z20": R.zh(k, 20) for k in base if k.endswith("d") and "corr" not in k}
    for n in (1, 3, 5):
        cols[f"div_spx_up_iwm_down_{n}d"] = flag((m("spx", n) > 0.5) & (m("iwm", n) < -0.5))
        cols[f"div_iwm_leads_spx_{n}d"] = flag(m("iwm", n) > m("spx", n) + 0.5)
    for n in (1, 5):
        cols[f"div_spx_gold_both_up_{n}d"] = flag((m("spx", n) > 0.5) & (m("gold", n) > 0.5))
        cols[f"div_gold_up_spx_down_{n}d"] = flag((m("gold", n) > 1.0) & (m("spx", n) < -0.5))
    three = [m("spx"), m("iwm"), m("qqq")]
    cols |= {"div_dax_leads_spx": flag(m("dax") > m("spx") + 1.0), "div_nikkei_crash": flag(m("nikkei") < -2.0), "div_nikkei_surge": flag(m("nikkei") > 2.0),
             "div_spx_bonds_positive_corr": flag(F.col("div_spx_bonds10_corr10d") > 0.3), "div_spx_bonds_flight": flag(F.col("div_spx_bonds10_corr10d") < -0.7),
             "div_triple_all_down": flag(all_of([x < -0.5 for x in three])), "div_triple_spx_only_up": flag((three[0] > 0.5) & (three[1] < 0) & (three[2] < 0)),
             "div_triple_high_dispersion": flag(F.col("div_triple_dispersion") > R.q("div_triple_dispersion", 20, 0.8))}
    out = out.withColumns(cols)
    return out.select("panel", d, *base, *cols)


# put/call pairs with their priority.
FLOW_PAIRS = [("spx_pc", "equity_pc", 3), ("vix_pc", "spx_pc", 3), ("iwm_pc", "spx_pc", 2), ("qqq_pc", "spx_pc", 2), ("spy_pc", "spx_pc", 2)]


def options_flow_composite(p: DataFrame, *, d="d") -> DataFrame:
    """put/call ratio pairs with z-score and percent rank, their composite level and dispersion, momentum and acceleration, and the product
    with the volatility index."""
    R = Rolling(d)
    have = [a for a in (*PUT_CALL, "spy_pc") if a in p.columns]
    base = {f"pcf_{a}_{b}_ratio": safe_ratio(a, b) for a, b in present(p, FLOW_PAIRS)}
    base |= {f"_z_{a}": R.zh(a, 20) for a in have} | {f"_m_{a}": R.mom(a) for a in have}
    out = p.withColumns(base)
    zs = [f"_z_{a}" for a in have]
    out = out.withColumns({"pcf_composite_level": row_mean(zs), "pcf_dispersion": row_std(zs)})
    level, spread = F.col("pcf_composite_level"), F.col("pcf_dispersion")
    cols = {}
    for k in [k for k in base if k.startswith("pcf_")]:
        cols |= {f"{k}_z20": R.zh(k, 20), f"{k}_pct252": R.rank(k)}
    cols |= {"pcf_composite_fear": flag(level > 1.5), "pcf_composite_greed": flag(level < -1.5), "pcf_convergence_high": flag((level > 1.0) & (spread < 0.5))}
    for a in have:
        cols |= {f"pcf_{a}_mom{n}d": R.mom(a, n) for n in (1, 3, 5)}
        cols[f"pcf_{a}_accel"] = (F.col(f"_m_{a}") - R.lag(f"_m_{a}", 3)) / 100.0
    cols |= {"pcf_spx_pc_x_vix": F.col("spx_pc") * F.col("vix") / 100.0, "pcf_double_fear": flag((F.col("spx_pc") > R.q("spx_pc", 20, 0.8)) & (F.col("vix") > 20))}
    out = out.withColumns(cols)
    return out.select("panel", d, *[k for k in base if k.startswith("pcf_")], "pcf_composite_level", "pcf_dispersion", *cols)


def refuge_triangle(p: DataFrame, *, d="d") -> DataFrame:
    """Flight to quality, inflation and recession flags, the gold/dollar ratio, and the refuge score."""
    R = Rolling(d)
    out = p.withColumns({"_g": R.mom("gold"), "_x": R.mom("dxy"), "_b": R.mom("bonds10"), "refuge_gold_dxy_ratio": safe_ratio("gold", "dxy")})
    g, x, b, r = F.col("_g"), F.col("_x"), F.col("_b"), "refuge_gold_dxy_ratio"
    score = flag(g > 0.5) + flag(x > 0.3) + flag(b > 0.2)
    cols = {"refuge_ftq_all": flag((g > 0.3) & (b > 0.1) & (x > 0.1)), "refuge_inflation_stress": flag((g > 0.5) & (b < -0.2) & (x > 0.2)),
            "refuge_recession_signal": flag((b > 0.3) & (x < -0.2)), f"{r}_z20": R.zh(r, 20), f"{r}_z60": R.zh(r, 60), f"{r}_pct252": R.rank(r),
            "refuge_gold_dxy_extreme": flag(R.zh(r, 60) > 2.0), "refuge_composite_score": score, "refuge_composite_max": flag(score == 3)}
    for a in ("gold", "dxy"):
        cols[f"refuge_{a}_mom5d"] = R.mom(a, 5)
        cols[f"refuge_{a}_strong_move"] = flag(F.abs(R.mom(a, 5)) > 2.0)
    out = out.withColumns(cols)
    return out.select("panel", d, r, *cols)


def cross_frequency_momentum(p: DataFrame, opening: DataFrame | None = None, *, d="d") -> DataFrame:
    """Agreement of daily momentum with the opening range's direction (``opening`` holds d and or_direction), accelerations, alignment,
    and volatility quadrants."""
    R = Rolling(d)
    out = p.withColumns({f"_m{n}": R.mom("spx", n) for n in (1, 3, 5, 10, 20)} | {"_v1": R.mom("vix"), "_v5": R.mom("vix", 5)})
    m = {n: F.col(f"_m{n}") for n in (1, 3, 5, 10, 20)}
    cols = {"cfm_spx_accel_1_5": m[1] - m[5] / 5, "cfm_spx_accel_5_20": m[5] / 5 - m[20] / 20,
            "cfm_spx_all_aligned_down": flag((m[1] < 0) & (m[5] < 0) & (m[20] < 0)), "cfm_spx_all_aligned_up": flag((m[1] > 0) & (m[5] > 0) & (m[20] > 0))}
    if opening is not None:
        out = out.join(opening.select(d, F.col("or_direction").alias("_or")), [d], "left")
        for n in m:
            agree = flag(((m[n] > 0) & (F.col("_or") > 0)) | ((m[n] < 0) & (F.col("_or") < 0)))
            cols |= {f"cfm_spx_or30_coherent_{n}d": agree, f"cfm_spx_or30_diverge_{n}d": 1.0 - agree}
    v, v1, v5 = F.col("vix"), F.col("_v1"), F.col("_v5")
    up, high = flag(v1 > 2), flag(v > 20)
    cols |= {"cfm_vix_accel": v1 - v5 / 5, "cfm_vix_spike_from_low": flag((v1 > 5) & (v < 18)), "cfm_vix_crush_from_high": flag((v1 < -5) & (v > 25)),
             "cfm_vix_trending_up_5d": flag((v5 > 10) & (v1 > 0)), "cfm_vix_quad_up_high": up * high, "cfm_vix_quad_up_low": up * (1.0 - high),
             "cfm_vix_quad_down_high": (1.0 - up) * high, "cfm_vix_quad_down_low": (1.0 - up) * (1.0 - high)}
    return out.select("panel", d, *[c.alias(k) for k, c in cols.items()])


def composite_regimes(p: DataFrame, *, d="d") -> DataFrame:
    """A stress score of up to six flags and its bands, volatility regimes from two z-scores, and strong and weak trends."""
    R = Rolling(d)
    vix, spx = F.col("vix"), F.col("spx")
    signals = [flag(vix > 20), flag(vix > R.mean("vix", 20) + R.std("vix", 20)), flag(F.col("vix9d") > vix), flag(spx < R.mean("spx", 20)),
               flag(F.col("ad") < R.mean("ad", 10)), flag(F.col("spx_pc") > R.q("spx_pc", 20, 0.7))]
    score = reduce(lambda a, b: a + b, signals)
    out = p.withColumns({"regime_stress_score": score, "_a": R.zh("vix", 60), "_b": R.zh("vvix", 60), "_m5": R.mom("spx", 5), "_m20": R.mom("spx", 20)})
    s, a, b, m5, m20 = (F.col(x) for x in ("regime_stress_score", "_a", "_b", "_m5", "_m20"))
    crisis, bull, bear = (a > 1.5) & (b > 1.5), (m5 > 2) & (m20 > 5), (m5 < -2) & (m20 < -5)
    top = len(signals) - 1
    cols = {"regime_stress_max": flag(s >= top), "regime_stress_moderate": flag((s >= 2) & (s < top)), "regime_calm": flag(s <= 1),
            "regime_vol_crisis": flag(crisis), "regime_vol_stress": flag((a > 0.5) & (b > 0.5) & ~truth(crisis)),
            "regime_vol_uncertainty": flag(((a > 0.5) & (b <= 0.5)) | ((a <= 0.5) & (b > 0.5))), "regime_vol_calm": flag((a <= 0) & (b <= 0)),
            "regime_spx_bull_strong": flag(bull), "regime_spx_bull_weak": flag((m5 > 0) & (m20 > 0) & ~truth(bull)), "regime_spx_bear_strong": flag(bear),
            "regime_spx_bear_weak": flag((m5 < 0) & (m20 < 0) & ~truth(bear))}
    return out.select("panel", d, "regime_stress_score", *[v.alias(k) for k, v in cols.items()])


def priorities() -> dict[str, int]:
    """Priority (1 to 3) of the cross-asset features that a pair or a rule gives one to; the rest count as 1."""
    out = {}
    for a, b, p in VOL_PAIRS:
        k = f"vts_{a}_{b}"
        out |= {f"{k}_{x}": p for x in ("ratio", "spread", "ratio_z20", "ratio_z60", "inverted", "inversion_new")} | {f"{k}_spread_accel3": p - 1}
    for a, b, p in FLOW_PAIRS:
        k = f"pcf_{a}_{b}_ratio"
        out |= {k: p, f"{k}_z20": p, f"{k}_pct252": p - 1}
    return out


# Features of priority 3 outside the pair rules, and those of priority 1; every other cross-asset feature has priority 2.
HIGH_PRIORITY = [
    "vts_vvix_vix_ratio", "vts_vvix_vix_ratio_z20", "vts_skew_vix_ratio", "vts_skew_vix_ratio_z20", "vts_composite_stress", "vts_composite_stress_extreme",
    "div_spx_iwm_1d", "div_spx_iwm_3d", "div_spx_iwm_5d", "div_spx_iwm_1d_z20", "div_spx_iwm_3d_z20", "div_spx_iwm_5d_z20", "div_nikkei_spx_1d",
    "div_nikkei_spx_1d_z20", "div_nikkei_crash", "div_gold_up_spx_down_1d", "div_gold_up_spx_down_5d", "div_spx_bonds10_corr10d", "div_spx_bonds_flight",
    "div_triple_all_down", "pcf_composite_level", "pcf_composite_fear", "pcf_convergence_high", "pcf_spx_pc_x_vix", "pcf_double_fear", "refuge_ftq_all",
    "refuge_inflation_stress", "refuge_gold_dxy_extreme", "refuge_composite_score", "refuge_composite_max", "cfm_spx_accel_1_5", "cfm_spx_all_aligned_down",
    "regime_stress_score", "regime_stress_max", "regime_stress_moderate", "regime_calm", "regime_vol_crisis", "regime_vol_stress", "regime_vol_uncertainty",
    "regime_vol_calm",
]
LOW_PRIORITY = ["refuge_gold_dxy_ratio_pct252"]
CROSS_PREFIXES = ("vts_", "div_", "pcf_", "refuge_", "cfm_", "regime_")


def priority_of(name: str) -> int | None:
    """Priority of a cross-asset feature; None for features of other families."""
    if not name.startswith(CROSS_PREFIXES):
        return None
    table = priorities()
    if name in table:
        return table[name]
    if name in LOW_PRIORITY:
        return 1
    return 3 if name in HIGH_PRIORITY or name.startswith(("cfm_vix_", "cfm_spx_or30_")) else 2


def to_long(family: DataFrame, *, d="d", ids=("panel",)) -> DataFrame:
    """A wide family as (ids, d, feature, value)."""
    names = [c for c in family.columns if c not in (*ids, d)]
    return melt(family, [*ids, d], {c: F.lit(c) for c in names})


def _long_priority(feature) -> Column:
    """``priority_of`` for a column of names; null for features of other families."""
    name, table = as_col(feature), priorities()
    by_level = {p: sorted(k for k, v in table.items() if v == p) for p in sorted(set(table.values()))}
    out = F.when(~any_of([name.startswith(p) for p in CROSS_PREFIXES]), F.lit(None).cast("int"))
    for p, named in by_level.items():
        out = out.when(name.isin(named), p)
    high = name.isin(HIGH_PRIORITY) | name.startswith("cfm_vix_") | name.startswith("cfm_spx_or30_")
    return out.when(name.isin(LOW_PRIORITY), 1).when(high, 3).otherwise(2)


def assemble_features(families, min_priority: int = 2, *, d="d", ids=("panel",)) -> DataFrame:
    """Long union of families; of equally named features the first family's is kept; cross-asset features below ``min_priority`` are
    dropped. Families may be wide or long (feature, value); both rules hold for both kinds. The names of an earlier long family are read
    from its rows: a later family loses them by an anti-join with its distinct names."""
    seen, read, parts = set(), None, []
    for fam in families:
        if {"feature", "value"} <= set(fam.columns):
            rows = fam.select(*[c if c in fam.columns else F.lit("market").alias(c) for c in ids], d, "feature", "value")
            rows = rows.filter(F.coalesce(_long_priority("feature"), F.lit(min_priority)) >= min_priority)
            if seen:
                rows = rows.filter(~F.col("feature").isin(sorted(seen)))
        else:
            names = [c for c in fam.columns if c not in (*ids, d) and c not in seen and (priority_of(c) or min_priority) >= min_priority]
            if not names:
                continue
            rows = to_long(fam.select(*ids, d, *names), d=d, ids=ids)
        if read is not None:
            rows = rows.join(read, "feature", "left_anti").select(*rows.columns)
        parts.append(rows)
        if {"feature", "value"} <= set(fam.columns):
            mine = rows.select("feature").distinct()
            read = mine if read is None else read.unionByName(mine)
        else:
            seen |= set(names)
    return reduce(lambda a, b: a.unionByName(b), parts)


def wide_features(features: DataFrame, names, *, d="d") -> DataFrame:
    """One row per session with the named features as columns."""
    return features.groupBy(d).pivot("feature", list(names)).agg(F.max("value"))


def trading_index(long: DataFrame, coverage: float = 0.5, *, by="series", d="d") -> DataFrame:
    """Business days on which at least the given share of all series has a row."""
    total = long.agg(F.count_distinct(by).alias("n")).scalar()
    days = long.filter(F.weekday(d) < 5).groupBy(d).agg(F.count_distinct(by).alias("n_series"))
    return days.filter(F.col("n_series") >= total * F.lit(coverage))


def session_split(features: DataFrame, ratio: float = 0.7, *, d="d") -> DataFrame:
    """The sessions in order with their number and whether they lie in the first ``ratio`` of all (in sample).

    One row per session: the numbering runs over the distinct dates only.
    """
    days = features.select(d).distinct().withColumn("_all", F.lit(1))
    rn = F.row_number().over(Window.partitionBy("_all").orderBy(d))
    n = F.count(F.lit(1)).over(Window.partitionBy("_all"))
    return days.withColumns({"session_no": rn, "n_sessions": n, "in_sample": rn <= F.floor(n * ratio)}).drop("_all")


def drop_sparse_and_impute(features: DataFrame, max_null: float = 0.40, is_ratio: float = 0.7, *, d="d") -> DataFrame:
    """Features with at most ``max_null`` missing sessions, missing values filled with the median of the first ``is_ratio`` of
    the sessions; a feature whose median is unknown stays only if nothing is missing. Input and result are long, one value per session.

    Which sessions a feature has is a bitmap per 64 sessions; only the sessions that are missing in it become new rows."""
    days = session_split(features, is_ratio, d=d)
    place = F.col("session_no") - 1
    days = days.withColumns({"_block": F.floor(place / 64).cast("int"), "_bit": F.expr("shiftleft(1L, cast((session_no - 1) % 64 as int))")})
    known = features.filter(F.col("value").isNotNull()).join(days, [d])
    stats = known.groupBy("feature").agg(F.count(F.lit(1)).alias("_have"), F.max("n_sessions").alias("_n"), F.percentile(F.when(F.col("in_sample"), F.col("value")), F.lit(0.5)).alias("_median"))
    stats = stats.filter((1 - F.col("_have") / F.col("_n") <= max_null) & (F.col("_median").isNotNull() | (F.col("_have") == F.col("_n"))))
    present = known.groupBy("feature", "_block").agg(F.bit_or("_bit").alias("_bits"))
    blocks = stats.filter("_have < _n").select("feature", "_median", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 64).cast("int"))).alias("_block"))
    holes = blocks.join(present, ["feature", "_block"], "left").select("feature", "_median", "_block", F.bitwise_not(F.coalesce("_bits", F.lit(0).cast("bigint"))).alias("_holes"))
    at = F.explode(F.expr("filter(sequence(0, 63), i -> getbit(_holes, i) = 1)"))
    missing = holes.filter("_holes <> 0").select("feature", "_median", "_block", at.alias("_i"))
    missing = missing.withColumn("session_no", F.col("_block") * 64 + F.col("_i") + 1).join(days.select(d, "session_no"), "session_no")
    kept = known.join(stats.select("feature"), "feature", "left_semi").select("feature", d, F.col("value").cast("double").alias("value"))
    return kept.unionByName(missing.select("feature", d, F.col("_median").cast("double").alias("value")))


def exclude_features(features: DataFrame, substrings=("vix1d", "vix1d_vix")) -> DataFrame:
    """Long features whose name holds none of the substrings."""
    name = F.lower("feature")
    return features.filter(~any_of([name.contains(s.lower()) for s in substrings]))


def amplitude_class(amplitude, strong: float = 0.45, weak: float = 0.23) -> Column:
    """2 at or above ``strong``, 0 at or below ``weak``, 1 between."""
    a = as_col(amplitude)
    return F.when(a >= strong, 2).when(a <= weak, 0).when(a.isNotNull(), 1)


def join_targets(features: DataFrame, targets: DataFrame, amplitude="abs_ret_pct", strong: float = 0.45, weak: float = 0.23, *, d="d", by=()) -> DataFrame:
    """Features with y_amp and y_cat of their session (for example from G4 at one horizon), once for every ``by`` group of the targets."""
    y = targets.select(*by, d, F.col(amplitude).alias("y_amp"), amplitude_class(amplitude, strong, weak).alias("y_cat")).filter("y_amp IS NOT NULL")
    return features.join(y, [d])


def daily_targets(bars: DataFrame, strong: float = 0.45, weak: float = 0.23, *, d="d") -> DataFrame:
    """H23, daily variant: the absolute open-to-close move in percent as target."""
    amp = F.abs(change_pct("close", "open"))
    return bars.select("symbol", d, amp.alias("y_amp"), amplitude_class(amp, strong, weak).alias("y_cat")).filter("y_amp IS NOT NULL")


def regime_filter(rows: DataFrame, levels: DataFrame, level_min: float | None = None, level_max: float | None = None, *, d="d", value="open") -> DataFrame:
    """Sessions whose same-day (last known) opening level of another series lies in a range."""
    from .joins import asof_join
    out = asof_join(rows, levels.select(d, F.col(value).alias("_level")), on=d)
    if level_max is not None:
        out = out.filter(F.col("_level") <= level_max)
    if level_min is not None:
        out = out.filter(F.col("_level") >= level_min)
    return out.drop("_level")


def quantile_buckets(df: DataFrame, value, labels=("low", "high"), *, by="symbol", name="bucket") -> DataFrame:
    """Equal-frequency labels from interpolated quantiles, right-closed; equal values share a bucket."""
    q = len(labels)
    edges = df.groupBy(*keys(by)).agg(F.percentile(as_col(value), F.array(*[F.lit(i / q) for i in range(1, q)])).alias("_e"))
    out = df.join(edges, keys(by), "left")
    v, label = as_col(value), None
    for i, text in enumerate(labels[:-1]):
        inside = v <= F.col("_e")[i]
        label = F.when(inside, text) if label is None else label.when(inside, text)
    return out.withColumn(name, label.when(v.isNotNull(), labels[-1])).drop("_e")


def bucket_coverage(df: DataFrame, outcomes, *, by="symbol", name="bucket") -> DataFrame:
    """Rows per bucket and rows with each outcome present."""
    return df.filter(F.col(name).isNotNull()).groupBy(*keys(by), name).agg(F.count(F.lit(1)).alias("n"), *[F.count(o).alias(f"n_{o}") for o in outcomes])
