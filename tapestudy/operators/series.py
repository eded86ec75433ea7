"""Base columns of a series: returns, leads, rolling statistics, crossings, streaks.

Each operator adds columns to a bar table with one row per (symbol, d).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, change, change_pct, flag, ratio, truth
from ..functions.windows import (rolling, rolling_correlation, rolling_percentile, rolling_rank_pct,
                                 rolling_z, sessions, whole)


def returns(df: DataFrame, *, symbol="symbol", d="d", close="close") -> DataFrame:
    """Previous and next close, their percentage changes, weekday (Monday = 0), month, year."""
    w = sessions(symbol, d)
    out = df.withColumns({"prev_close": F.lag(close).over(w), "next_close": F.lead(close).over(w)})
    return out.withColumns({
        "var_pct": change_pct(close, "prev_close"), "next_var": change_pct("next_close", close),
        "dow": F.weekday(d), "month": F.month(d), "year": F.year(d)})


def forward_closes(df: DataFrame, horizon: int = 5, *, symbol="symbol", d="d", with_high: bool = False) -> DataFrame:
    """Close, low and percentage change of each of the next ``horizon`` sessions."""
    w = sessions(symbol, d)
    hs = range(1, horizon + 1)
    cols = {f"close_j{h}": F.lead("close", h).over(w) for h in hs}
    cols |= {f"low_j{h}": F.lead("low", h).over(w) for h in hs}
    if with_high:
        cols |= {f"high_j{h}": F.lead("high", h).over(w) for h in hs}
    return df.withColumns(cols).withColumns({f"var_j{h}": change_pct(f"close_j{h}", "close") for h in hs})


def bars_for_minutes(minutes: int, bar_minutes: int) -> int:
    """Number of bars that cover ``minutes``, at least one."""
    return max(1, int(minutes // bar_minutes))


def forward_return(df: DataFrame, bars=1, *, symbol="symbol", d="d", close="close", name="fwd_return") -> DataFrame:
    """D3: return over the next n bars, or from bar ``start`` to bar ``end`` ahead for a pair."""
    w = sessions(symbol, d)
    if isinstance(bars, tuple):
        start, end = bars
        value = change(F.lead(close, end).over(w), F.lead(close, start).over(w))
    else:
        value = change(F.lead(close, bars).over(w), close)
    return df.withColumn(name, value)


def gap(df: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """Opening gap to the previous close, and the overnight move to the next open, in percent."""
    w = sessions(symbol, d)
    return df.withColumns({"gap_pct": change_pct("open", F.lag("close").over(w)),
                           "overnight_pct": change_pct(F.lead("open").over(w), "close")})


def bar_returns(df: DataFrame) -> DataFrame:
    """Open-to-close return, its absolute value, and the range, in percent."""
    oc = change_pct("close", "open")
    return df.withColumns({"open_close_pct": oc, "abs_open_close_pct": F.abs(oc),
                           "range_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 100.0})


def volume_features(df: DataFrame, window: int = 20, *, symbol="symbol", d="d") -> DataFrame:
    """Mean volume over 20 sessions, the ratio to it, and the count of rises in the last three."""
    w = sessions(symbol, d)
    rising = F.when(F.col("volume") > F.lag("volume").over(w), 1).otherwise(0)
    out = df.withColumns({"vol_ma20": rolling("mean", "volume", w, window), "_rise": rising})
    return out.withColumns({"vol_ratio": ratio("volume", "vol_ma20"),
                            "vol_up3": rolling("sum", "_rise", w, 3)}).drop("_rise")


def rolling_stat(df: DataFrame, value, window: int, stat: str = "mean", min_periods: int | None = None, *,
                 name=None, symbol="symbol", d="d") -> DataFrame:
    """Rolling mean, std, min, max, sum or count."""
    return df.withColumn(name or f"{stat}{window}", rolling(stat, value, sessions(symbol, d), window, min_periods))


def zscore(df: DataFrame, value, window: int, min_periods: int | None = None, *, name=None, symbol="symbol",
           d="d") -> DataFrame:
    """Rolling z-score, null when the deviation is 0."""
    return df.withColumn(name or f"z{window}", rolling_z(value, sessions(symbol, d), window, min_periods))


def rolling_quantile(df: DataFrame, value, window: int, q: float, min_periods: int | None = None, *, name=None,
                     symbol="symbol", d="d") -> DataFrame:
    """Interpolated rolling quantile."""
    name = name or f"q{int(q * 100)}_{window}"
    return df.withColumn(name, rolling_percentile(value, q, sessions(symbol, d), window, min_periods))


def rolling_pct_rank(df: DataFrame, value, window: int = 252, min_periods: int | None = 60, *, name=None,
                     symbol="symbol", d="d") -> DataFrame:
    """Rolling percent rank of the current value, ties averaged."""
    return df.withColumn(name or f"pct{window}", rolling_rank_pct(value, sessions(symbol, d), window, min_periods))


def rolling_corr(df: DataFrame, a, b, window: int = 20, min_periods: int | None = None, *, name=None,
                 symbol="symbol", d="d") -> DataFrame:
    """Rolling Pearson correlation of two columns."""
    return df.withColumn(name or f"corr{window}",
                         rolling_correlation(a, b, sessions(symbol, d), window, min_periods))


def pct_change(value, n: int, w) -> Column:
    return change(value, F.lag(as_col(value), n).over(w))


def momentum(df: DataFrame, value="close", windows=(1, 3, 5, 10, 20), *, symbol="symbol", d="d") -> DataFrame:
    """Percentage momentum over several windows, its 5-session acceleration, and the 3-row difference."""
    w = sessions(symbol, d)
    out = df.withColumns({f"mom{n}": pct_change(value, n, w) * 100.0 for n in windows} |
                         {"_mom5": pct_change(value, 5, w) * 100.0, "diff3": F.col(value) - F.lag(value, 3).over(w)})
    return out.withColumn("accel5", F.col("_mom5") - F.lag("_mom5", 5).over(w)).drop("_mom5")


def lags(df: DataFrame, value="close", steps=(2, 3, 5, 10), pairs=((1, 3), (1, 5), (3, 10), (5, 10)), *,
         symbol="symbol", d="d") -> DataFrame:
    """Lagged values and differences between two lags."""
    w = sessions(symbol, d)
    cols = {f"lag{n}": F.lag(value, n).over(w) for n in steps}
    cols |= {f"diff_{a}_{b}": F.lag(value, a).over(w) - F.lag(value, b).over(w) for a, b in pairs}
    return df.withColumns(cols)


def crossing(above: Column, w, existing_only: bool = True):
    """Columns for crossing up and down, given a condition "above" that is null when unknown.

    An unknown condition counts as "not above", as a comparison with a missing number does.
    """
    now, before = truth(above), truth(F.lag(above).over(w))
    return flag(now & ~before), flag(~now & before)


def ma_cross(df: DataFrame, value="close", window: int = 20, min_periods: int | None = None, *, symbol="symbol",
             d="d") -> DataFrame:
    """Crossing of the moving average between the previous and the current session."""
    w = sessions(symbol, d)
    out = df.withColumn("_above", F.col(value) > rolling("mean", value, w, window, min_periods or window // 2))
    up, down = crossing(F.col("_above"), w)
    return out.withColumns({f"cross_ma{window}_up": up, f"cross_ma{window}_down": down}).drop("_above")


def level_cross(df: DataFrame, value="close", level: float = 20.0, *, name=None, symbol="symbol", d="d") -> DataFrame:
    """Crossing of a fixed level. Both sides need a previous value."""
    w = sessions(symbol, d)
    before = F.lag(value).over(w)
    name = name or f"cross_{level:g}"
    return df.withColumns({f"{name}_up": flag((F.col(value) >= level) & (before < level)),
                           f"{name}_down": flag((F.col(value) < level) & (before >= level))})


def breakout(df: DataFrame, value="close", windows=(5, 10, 20), *, symbol="symbol", d="d") -> DataFrame:
    """The value is at its w-session high or low (window includes the current row)."""
    w = sessions(symbol, d)
    cols = {}
    for n in windows:
        cols[f"breakout_up{n}"] = flag(F.col(value) >= rolling("max", value, w, n, n // 2))
        cols[f"breakout_down{n}"] = flag(F.col(value) <= rolling("min", value, w, n, n // 2))
    return df.withColumns(cols)


def drawdown(df: DataFrame, value="close", window: int = 252, min_periods: int = 60, *, symbol="symbol",
             d="d") -> DataFrame:
    """Distance to the rolling high and low in percent, drawdown flags, recovering flag."""
    w = sessions(symbol, d)
    out = df.withColumns({
        "dist_high_pct": change_pct(value, rolling("max", value, w, window, min_periods)),
        "dist_low_pct": change_pct(value, rolling("min", value, w, window, min_periods))})
    dd = F.col("dist_high_pct")
    return out.withColumns({"dd_5": flag(dd < -5), "dd_10": flag(dd < -10),
                            "recovering": flag((dd > F.lag(dd, 5).over(w)) & (dd < -3))})


def streak(df: DataFrame, value="var_pct", *, symbol="symbol", d="d") -> DataFrame:
    """Consecutive ups and downs, and the signed run length.

    ``consec_up``/``consec_dn`` count the rows of the current run of rises/falls (0 outside one);
    ``streak`` is the run length with the sign of "rise or not".
    """
    w = sessions(symbol, d)
    up, down = truth(F.col(value) > 0), truth(F.col(value) < 0)
    out = df.withColumns({"_n": F.row_number().over(w), "_up": up, "_dn": down})
    # the row number of the last row at which the condition was false (or true) marks the run's start
    last_not_up = F.coalesce(F.last(F.when(~F.col("_up"), F.col("_n")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    last_up = F.coalesce(F.last(F.when(F.col("_up"), F.col("_n")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    last_not_dn = F.coalesce(F.last(F.when(~F.col("_dn"), F.col("_n")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    out = out.withColumns({"consec_up": F.col("_n") - last_not_up, "consec_dn": F.col("_n") - last_not_dn,
                           "_flat": F.col("_n") - last_up})
    return out.withColumn("streak", F.when(F.col("_up"), F.col("consec_up")).otherwise(-F.col("_flat"))).drop(
        "_n", "_up", "_dn", "_flat")


def atr(df: DataFrame, windows=(5, 14), *, symbol="symbol", d="d") -> DataFrame:
    """True range and its rolling means (half-filled windows count), in percent of the previous close."""
    w = sessions(symbol, d)
    prev = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    out = df.withColumns({"_prev": prev, "_tr": tr})
    cols = {"true_range_pct": F.try_divide(F.col("_tr"), F.col("_prev")) * 100.0}
    cols |= {f"atr{n}": F.try_divide(rolling("mean", "_tr", w, n, n // 2), F.col("_prev")) * 100.0 for n in windows}
    return out.withColumns(cols).drop("_prev", "_tr")


def candle_geometry(df: DataFrame) -> DataFrame:
    """Body, shadows and close position of each bar. Shadows are in percent of their outer body edge or high."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = F.nullif(h - l, F.lit(0.0))
    body_ratio = F.try_divide(F.abs(c - o), span)
    return df.withColumns({
        "body_pct": F.try_divide(F.abs(c - o), o) * 100.0, "direction": F.signum(c - o),
        "upper_shadow_pct": F.greatest(F.try_divide(h - F.greatest(o, c), h) * 100.0, F.lit(0.0)),
        "lower_shadow_pct": F.greatest(F.try_divide(F.least(o, c) - l, F.least(o, c)) * 100.0, F.lit(0.0)),
        "close_position": F.try_divide(c - l, span), "body_ratio": body_ratio,
        "doji": flag(body_ratio < 0.1), "effort": span * F.col("volume") / 1e6})


def realized_vol(df: DataFrame, windows=(5, 10, 20), *, symbol="symbol", d="d", close="close") -> DataFrame:
    """Standard deviation of daily percentage returns; half-filled windows count."""
    w = sessions(symbol, d)
    out = df.withColumn("_ret", pct_change(close, 1, w) * 100.0)
    return out.withColumns({f"vol{n}": rolling("std", "_ret", w, n, n // 2) for n in windows}).drop("_ret")


def ex_ante_returns(df: DataFrame, *, symbol="symbol", d="d", close="close") -> DataFrame:
    """One-, two- and four-week returns and 5-session deviation, all known before the session."""
    w = sessions(symbol, d)
    last = F.lag(close, 1).over(w)
    out = df.withColumns({f"ret_{weeks}w": change(last, F.lag(close, weeks * 5 + 1).over(w)) for weeks in (1, 2, 4)} |
                         {"_ret": pct_change(close, 1, w)})
    out = out.withColumn("_std", rolling("std", "_ret", w, 5))
    return out.withColumn("std5_prev", F.lag("_std").over(w)).drop("_ret", "_std")


def pair_feature(left: DataFrame, right: DataFrame, op: str = "ratio", window: int = 20, *, d="d",
                 value="close", years: float | None = None) -> DataFrame:
    """A derived series of two series on their common dates.

    ``op``: ratio, spread, mean_ratio (rolling mean of the ratio) or zscore (rolling z of the ratio);
    plus its 1-day change and rolling z-score. ``years`` keeps the last years of the common dates
    before anything is computed. ``left`` may hold several symbols; ``right`` is one series by date.
    """
    a = left.select("symbol", d, F.col(value).alias("_a"))
    b = right.select(d, F.col(value).alias("_b"))
    both = a.join(b, [d])
    if years is not None:
        both = (both.withColumn("_newest", F.max(d).over(whole("symbol")))
                .filter(F.col(d) >= F.date_sub("_newest", int(years * 365.25))).drop("_newest"))
    w = sessions("symbol", d)
    quotient = F.try_divide(F.col("_a"), F.col("_b"))
    derived = {"ratio": quotient, "spread": F.col("_a") - F.col("_b"),
               "mean_ratio": rolling("mean", quotient, w, window), "zscore": rolling_z(quotient, w, window)}[op]
    out = both.withColumn("derived", derived).drop("_a", "_b")
    return out.withColumns({"change_1d": change("derived", F.lag("derived").over(w)),
                            "derived_z": rolling_z("derived", w, window)})
