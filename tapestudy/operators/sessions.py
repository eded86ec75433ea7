"""Intraday sessions.

Bars carry symbol, ts, d and minute_of_day, one row per symbol and time. Groups and windows are keyed by
(symbol, d), at most one day of bars, so a hot symbol spreads over its days; only per-session tables (one row per
symbol and day) are ordered across days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, change, change_pct, count_where, flag, hhmm, mean_where, median, pearson, truth
from ..functions.windows import keys, rolling_percentile, rolling_z, sessions
from .filters import time_window
from .joins import asof_join

OPEN, CLOSE = "09:30", "16:00"

# Minutes after the entry, and the big-move and calm limits in percent.
HORIZONS = (30, 60, 90, 120, 150, 180, 240, 300, 390)
BIG_MOVE, CALM = 0.45, 0.23
CALM_FROM_MINUTES = 120


def day_window(symbol="symbol", d="d"):
    return Window.partitionBy(*keys(symbol), d)


def first_of(value, when=None, ts="ts"):
    """Aggregate: value of the earliest bar (among those where ``when`` holds)."""
    return F.min_by(as_col(value), as_col(ts) if when is None else F.when(when, as_col(ts)))


def last_of(value, when=None, ts="ts"):
    return F.max_by(as_col(value), as_col(ts) if when is None else F.when(when, as_col(ts)))


def session_bounds(df: DataFrame, *, symbol="symbol", d="d", ts="ts") -> DataFrame:
    """First and last time of each day, rows, and the previous session with its last time."""
    out = df.groupBy(*keys(symbol), d).agg(F.min(ts).alias("open_ts"), F.max(ts).alias("close_ts"), F.count(F.lit(1)).alias("rows"))
    w = sessions(symbol, d)
    return out.withColumns({"prev_close_ts": F.lag("close_ts").over(w), "prev_d": F.lag(d).over(w)})


def attach_session(df: DataFrame, *, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """Regular hours inferred per symbol, the session each bar belongs to, and its part of the day.

    The open is the earliest time between 09:00 and 10:30, the close the latest between 15:00 and 17:00. Bars after
    the close belong to the symbol's next trading day (null after the last one).
    """
    m = F.col(minute)
    bounds = df.groupBy(*keys(symbol)).agg(
        F.coalesce(F.min(F.when(m.between(540, 630), m)), F.min(m)).alias("regular_open"),
        F.coalesce(F.max(F.when(m.between(900, 1020), m)), F.max(m)).alias("regular_close"))
    days = df.select(*keys(symbol), d).distinct().withColumn("_next_d", F.lead(d).over(sessions(symbol, d)))
    out = df.join(bounds, keys(symbol)).join(days, [*keys(symbol), d])
    after = m > F.col("regular_close")
    return out.withColumns({
        "session_d": F.when(after, F.col("_next_d")).otherwise(F.col(d)), "is_regular": (m >= F.col("regular_open")) & ~after,
        "is_premarket": m < F.col("regular_open"), "is_after_hours": after}).drop("_next_d")


def entry_sessions(df: DataFrame, entry: str = OPEN, horizons=HORIZONS, big: float = BIG_MOVE, calm: float = CALM, min_bars: int = 1, *,
                   symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """One row per session and horizon: entry price (open of the first bar at or after the entry time), last close
    within the horizon, signed and absolute moves, big-move and calm flags, and the gap of the entry to the previous
    session's 16:00 close. All horizons are conditional aggregates over one grouping of the session's bars."""
    m = F.col(minute)
    bars = time_window(df, OPEN, CLOSE, minute=minute)
    at = F.min(F.when(m >= hhmm(entry), m)).over(day_window(symbol, d))
    bars = bars.withColumn("_at", at)
    started = m >= F.col("_at")
    aggs = [F.count(F.lit(1)).alias("_n"), F.min_by("open", F.when(started, m)).alias("entry_price"),
            F.coalesce(F.max(F.when(m == hhmm(CLOSE), F.col("close"))), F.max_by("close", m)).alias("close_1600")]
    for h in horizons:
        inside = started & (m <= F.col("_at") + h)
        aggs += [F.max_by("close", F.when(inside, m)).alias(f"_c{h}"), F.max(F.when(inside, F.col("high"))).alias(f"_h{h}"),
                 F.min(F.when(inside, F.col("low"))).alias(f"_l{h}")]
    days = bars.groupBy(*keys(symbol), d).agg(*aggs).filter((F.col("_n") >= min_bars) & F.col("entry_price").isNotNull())
    prev = F.lag("close_1600").over(sessions(symbol, d))
    days = days.withColumn("gap_pct", change_pct("entry_price", prev))
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_c{h}").alias("price"), F.col(f"_h{h}").alias("_high"), F.col(f"_l{h}").alias("_low"))
                     for h in horizons])
    out = days.select(*keys(symbol), d, "entry_price", "close_1600", "gap_pct", F.inline(rows))
    ep = F.col("entry_price")
    ret = change_pct("price", ep)
    excursion = F.greatest(F.abs(F.col("_high") - ep), F.abs(F.col("_low") - ep)) / ep * 100.0
    return out.withColumns({"ret_pct": ret, "abs_ret_pct": F.abs(ret), "abs_pts": F.abs(F.col("price") - ep), "big_move": F.abs(ret) >= big,
                            "calm": F.when(F.col("horizon") >= CALM_FROM_MINUTES, excursion <= calm)}).drop("_high", "_low")


def amplitude_stats(entries: DataFrame, min_n: int = 10, *, symbol="symbol") -> DataFrame:
    """Per horizon the number of sessions, mean and median amplitude, points, share of big moves and calm sessions."""
    out = entries.groupBy(*keys(symbol), "horizon").agg(
        F.count("abs_ret_pct").alias("n"), F.avg("abs_ret_pct").alias("mean_pct"), median("abs_ret_pct").alias("median_pct"), F.avg("abs_pts").alias("mean_pts"),
        (F.avg(F.col("big_move").cast("double")) * 100.0).alias("big_pct"), (F.avg(F.col("calm").cast("double")) * 100.0).alias("calm_pct"))
    return out.filter(F.col("n") >= min_n)


def horizon_rank(entries: DataFrame, min_n: int = 10, *, symbol="symbol") -> DataFrame:
    """Horizons by mean amplitude, largest first."""
    stats = amplitude_stats(entries, min_n, symbol=symbol)
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(*keys(symbol)).orderBy(F.col("mean_pct").desc(), "horizon")))


def to_session(bars: DataFrame, session_days: DataFrame, after_minute: int, before_minute: int, *, symbol="symbol", d="d",
               minute="minute_of_day", inclusive_after: bool = False) -> DataFrame:
    """Overnight bars with the session they lead to: bars before ``before_minute`` belong to the first session on or
    after their day, bars after ``after_minute`` to the first session on or after the next day."""
    m = F.col(minute)
    evening = m >= after_minute if inclusive_after else m > after_minute
    night = bars.filter(evening | (m < before_minute))
    night = night.withColumn("_t", F.when(m < before_minute, F.col(d)).otherwise(F.date_add(d, 1)))
    days = session_days.select(*keys(symbol), F.col(d).alias("_t")).distinct()
    return asof_join(night, days, on="_t", by=symbol, columns=[], direction="forward", right_time="session_d", right_unique=True).drop("_t")


def overnight_vs_day(futures: DataFrame, day_bars: DataFrame, min_bars: int = 2, *, symbol="symbol", d="d", ts="ts") -> DataFrame:
    """The overnight return of each session's night (after 16:00 to before 09:30) beside the session's own return."""
    regular = time_window(day_bars, OPEN, CLOSE)
    day = regular.groupBy(*keys(symbol), d).agg(change_pct(last_of("close"), first_of("open")).alias("day_ret"))
    night = to_session(futures, day, hhmm(CLOSE), hhmm(OPEN), symbol=symbol, d=d)
    night = night.filter("session_d IS NOT NULL").groupBy(*keys(symbol), F.col("session_d").alias(d)).agg(
        F.count(F.lit(1)).alias("_n"), change_pct(last_of("close"), first_of("open")).alias("overnight_ret"))
    return night.filter(F.col("_n") >= min_bars).drop("_n").join(day, [*keys(symbol), d])


def overnight_correlation(pairs: DataFrame, *, symbol="symbol") -> DataFrame:
    """Correlation of overnight and day returns and the share with the same direction."""
    same = (F.col("overnight_ret") > 0) == (F.col("day_ret") > 0)
    return pairs.groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("n"), pearson("overnight_ret", "day_ret").alias("corr"),
                                            (F.avg(same.cast("double")) * 100.0).alias("same_direction_pct"), F.avg("overnight_ret").alias("mean_overnight"))


def overnight_features(night_bars: DataFrame, session_days: DataFrame, days_back: int = 3, min_bars: int = 2, *, symbol="symbol", d="d", ts="ts",
                       minute="minute_of_day") -> DataFrame:
    """Features of the night bars (after 16:00 or up to 09:30) of the last ``days_back`` days before each session.

    Each bar is offered to the few sessions it can precede and matched to the session days by equality.
    """
    m = F.col(minute)
    bars = night_bars.filter((m > hhmm(CLOSE)) | (m <= hhmm(OPEN)))
    offset = F.explode(F.sequence(F.lit(0), F.lit(days_back))).alias("_k")
    bars = bars.select("*", offset).filter((F.col("_k") > 0) | (m <= hhmm(OPEN)))
    bars = bars.withColumn("session_d", F.date_add(d, F.col("_k"))).drop(d)
    days = session_days.select(*keys(symbol), F.col(d).alias("session_d")).distinct()
    bars = bars.join(days, [*keys(symbol), "session_d"], "left_semi")
    w = Window.partitionBy(*keys(symbol), "session_d")
    bars = bars.withColumns({"_rn": F.row_number().over(w.orderBy(ts)), "_n": F.count(F.lit(1)).over(w)}).filter(F.col("_n") >= min_bars)
    mid = F.floor(F.col("_n") / 2)
    has_rsi = "rsi" in night_bars.columns
    out = bars.groupBy(*keys(symbol), F.col("session_d").alias(d)).agg(
        F.count(F.lit(1)).alias("n_bars"), first_of("open", ts=ts).alias("_o"), last_of("close", ts=ts).alias("last_close"), F.max("high").alias("_h"),
        F.min("low").alias("_l"), F.sum("volume").alias("volume"), last_of("open", ts=ts).alias("_lo"),
        F.max(F.when(F.col("_rn") == mid, F.col("close"))).alias("_mid_close"), F.max(F.when(F.col("_rn") == mid + 1, F.col("open"))).alias("_mid_open"),
        *([last_of("rsi", F.col("rsi").isNotNull(), ts=ts).alias("rsi_last")] if has_rsi else []))
    ret = change_pct("last_close", "_o")
    first, second = change_pct("_mid_close", "_o"), change_pct("last_close", "_mid_open")
    return out.withColumns({
        "ret_pct": ret, "direction": F.when(ret > 0, 1).otherwise(-1), "abs_ret_pct": F.abs(ret),
        "range_pct": F.try_divide(F.col("_h") - F.col("_l"), F.col("_l")) * 100.0, "last_bar_ret": change_pct("last_close", "_lo"),
        "first_half": first, "second_half": second, "accel": second - first}).drop("_o", "_h", "_l", "_lo", "_mid_close", "_mid_open")


def bar_features_at(df: DataFrame, times=("09:30", "10:00"), columns=("open", "high", "low", "close", "volume"), *, symbol="symbol", d="d",
                    minute="minute_of_day") -> DataFrame:
    """The columns of the bars at given times, their amplitude, direction and close position, and the cumulative
    return from the first to the last time (two bars needed)."""
    m = F.col(minute)
    lo, hi = hhmm(times[0]), hhmm(times[-1])
    span = m.between(lo, hi)
    at = {t: f"b{t.replace(':', '')}" for t in times}
    aggs = [F.max(F.when(m == hhmm(t), F.col(c))).alias(f"{p}_{c}") for t, p in at.items() for c in columns]
    aggs += [F.count_if(span).alias("_n"), F.min_by("open", F.when(span, m)).alias("_o"), F.max_by("close", F.when(span, m)).alias("_c")]
    out = df.filter(span).groupBy(*keys(symbol), d).agg(*aggs)
    cols = {}
    for p in at.values():
        o, h, l, c = (F.col(f"{p}_{x}") for x in ("open", "high", "low", "close"))
        cols[f"{p}_amp"] = F.abs(change_pct(c, o))
        cols[f"{p}_dir"] = F.when(c > o, 1).when(c.isNotNull(), -1)
        cols[f"{p}_close_pos"] = F.when(h > l, F.try_divide(c - l, h - l))
    cum = F.when(F.col("_n") >= 2, change_pct("_c", "_o"))
    return out.withColumns(cols | {"cum_ret": cum, "cum_amp": F.abs(cum)}).drop("_n", "_o", "_c")


def opening_range(df: DataFrame, minutes: int = 30, min_bars: int = 2, *, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """High-low of the first minutes after 09:30 in points and percent, open, return and direction."""
    m = F.col(minute)
    out = df.filter((m >= hhmm(OPEN)) & (m < hhmm(OPEN) + minutes)).groupBy(*keys(symbol), d).agg(
        F.count(F.lit(1)).alias("_n"), F.max("high").alias("or_high"), F.min("low").alias("or_low"), F.min_by("open", m).alias("or_open"),
        F.max_by("close", m).alias("_c")).filter(F.col("_n") >= min_bars)
    pts = F.col("or_high") - F.col("or_low")
    return out.withColumns({"or_points": pts, "or_pct": F.try_divide(pts, F.col("or_open")) * 100.0, "or_ret_pct": change_pct("_c", "or_open"),
                            "or_direction": F.when(F.col("_c") > F.col("or_open"), 1.0).otherwise(-1.0)}).drop("_n", "_c")


def prior_day_intraday_features(df: DataFrame, *, min_day: int = 10, min_last30: int = 3, min_first60: int = 6, min_or30: int = 4,
                                min_night: int = 3, min_premarket: int = 2, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """Features of the previous session (amplitude, close position, last-30 and first-60-minute returns, opening range and
    its ratio, afternoon/morning volume, closing indicators if present), of the night before the session (18:00 to 09:30, premarket
    07:30 to 09:30), and 20-session z-scores. One row per session that has a regular bar.

    One grouping per part; the previous session is the previous row of the symbol's sessions.
    """
    m = F.col(minute)
    sym = keys(symbol)
    day = time_window(df, OPEN, CLOSE, minute=minute)

    def ret_between(cond, need):
        return F.when(F.count_if(cond) >= need, change_pct(F.max_by("close", F.when(cond, m)), F.min_by("open", F.when(cond, m))))

    last30, first60, or30 = m >= hhmm("15:30"), m <= hhmm("10:30"), m < hhmm("10:00")
    morning, afternoon = m < hhmm("13:00"), m >= hhmm("13:00")
    carried = [c for c in ("rsi", "vwap", "upper", "lower", "williams_vix_fix") if c in df.columns]
    stats = day.groupBy(*sym, d).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("open", m).alias("_o"), F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", m).alias("_c"),
        ret_between(last30, min_last30).alias("last30_ret"), ret_between(first60, min_first60).alias("first60_ret"),
        F.when(F.count_if(or30) >= min_or30, F.max(F.when(or30, F.col("high"))) - F.min(F.when(or30, F.col("low")))).alias("_or"),
        F.try_divide(F.sum(F.when(afternoon, F.col("volume"))), F.nullif(F.sum(F.when(morning, F.col("volume"))), F.lit(0.0))).alias("vol_ratio"),
        *[F.max_by(c, m).alias(f"_{c}") for c in carried])
    span = F.col("_h") - F.col("_l")
    enough = F.col("_n") >= min_day
    amplitude, opening = F.try_divide(span, F.col("_o")) * 100.0, F.try_divide(F.col("_or"), F.col("_o")) * 100.0
    named = {"amplitude": amplitude, "close_pos": F.try_divide(F.col("_c") - F.col("_l"), span), "last30_ret": F.col("last30_ret"),
             "first60_ret": F.col("first60_ret"), "or30_range": opening, "or30_ratio": F.try_divide(opening, amplitude), "vol_ratio": F.col("vol_ratio")}
    if "rsi" in carried:
        named["rsi_close"] = F.col("_rsi")
    if "williams_vix_fix" in carried:
        named["wvf_close"] = F.col("_williams_vix_fix")
    if "vwap" in carried:
        named["close_vs_vwap"] = change_pct("_c", "_vwap")
    if "upper" in carried and "lower" in carried:
        named["bb_pos"] = F.try_divide(F.col("_c") - F.col("_lower"), F.when(F.col("_upper") > F.col("_lower"), F.col("_upper") - F.col("_lower")))
    w = sessions(sym, d)
    own = stats.select(*sym, d, *[F.when(enough, v).alias(k) for k, v in named.items()])
    prior = own.select(*sym, d, *[F.lag(k).over(w).alias(f"jm1_{k}") for k in named])

    night = to_session(df, stats, hhmm("18:00"), hhmm(OPEN), symbol=symbol, d=d, minute=minute, inclusive_after=True).filter("session_d IS NOT NULL")
    pre = (F.col(d) == F.col("session_d")) & (m >= hhmm("07:30")) & (m < hhmm(OPEN))
    night = night.groupBy(*sym, "session_d").agg(
        F.count(F.lit(1)).alias("_n"), first_of("open").alias("_o"), last_of("close").alias("_c"), F.max("high").alias("_h"), F.min("low").alias("_l"),
        F.sum("volume").alias("_v"), F.when(F.count_if(pre) >= min_premarket, change_pct(last_of("close", pre), first_of("open", pre))).alias("premkt_ret"))
    ok = F.col("_n") >= min_night
    night = night.select(*sym, F.col("session_d").alias(d), F.when(ok, change_pct("_c", "_o")).alias("ov_ret"),
                         F.when(ok, F.try_divide(F.col("_h") - F.col("_l"), F.col("_o")) * 100.0).alias("ov_range"), F.when(ok, F.col("_v")).alias("ov_vol"),
                         F.when(ok, F.col("premkt_ret")).alias("premkt_ret"))
    out = prior.join(night, [*sym, d], "left")
    scored = [f"jm1_{k}" for k in ("amplitude", "close_pos", "or30_range", "or30_ratio", "close_vs_vwap", "bb_pos") if k in named] + ["ov_ret", "ov_range", "premkt_ret"]
    cols = {f"{c}_z20": rolling_z(c, w, 20, 10) for c in scored}
    cols |= {"close_top_third": flag(F.col("jm1_close_pos") > 0.67), "close_bottom_third": flag(F.col("jm1_close_pos") < 0.33),
             "gap_up": flag(F.col("ov_ret") > 0.3), "gap_down": flag(F.col("ov_ret") < -0.3),
             "large_overnight": flag(F.col("ov_range") > rolling_percentile("ov_range", 0.8, w, 20))}
    return out.withColumns(cols)


def window_return(df: DataFrame, minutes: int, *, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """Percentage from the 09:30 open to the close of the bar exactly n minutes later."""
    start = hhmm(OPEN)
    m = F.col(minute)
    out = df.filter(m.isin(start, start + minutes)).groupBy(*keys(symbol), d).agg(
        F.max(F.when(m == start, F.col("open"))).alias("_o"), F.max(F.when(m == start + minutes, F.col("close"))).alias("_c"))
    return out.withColumn("var_pct", change_pct("_c", "_o")).filter("var_pct IS NOT NULL").drop("_o", "_c")


def session_targets(daily: DataFrame, intraday: DataFrame, offsets=(30, 60, 120), *, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """The day's open-to-close move, the move to the next open, and the moves from the 09:30 open to the bars 30, 60 and 120
    minutes later, in percent. Days without intraday bars keep nulls."""
    m, start = F.col(minute), hhmm(OPEN)
    marks = intraday.groupBy(*keys(symbol), d).agg(F.max(F.when(m == start, F.col("open"))).alias("_o"), *[
        F.max(F.when(m == start + k, F.col("close"))).alias(f"_c{k}") for k in offsets])
    marks = marks.select(*keys(symbol), d, *[change_pct(f"_c{k}", "_o").alias(f"ret_{k}min") for k in offsets])
    day = daily.select(*keys(symbol), d, change_pct("close", "open").alias("ret_close"), change_pct(F.lead("open").over(sessions(symbol, d)), "close").alias("ret_open_next"))
    return day.join(marks, [*keys(symbol), d], "left")


def horizon_return_from_open(df: DataFrame, minutes: int, cash_hours: bool = True, *, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """Return from the session's first open to the close of the bar nearest to ``minutes`` later, within
    max(5, minutes) minutes; the earlier bar on ties."""
    m = F.col(minute)
    rows = df.filter(F.col("open").isNotNull() & F.col("close").isNotNull())
    rows = time_window(rows, OPEN, CLOSE, minute=minute) if cash_hours else rows
    rows = rows.withColumn("_off", m - F.min(m).over(day_window(symbol, d)) - minutes)
    distance = F.abs("_off") * 2 + F.when(F.col("_off") > 0, 1).otherwise(0)
    near = F.when(F.abs("_off") <= max(5, minutes), distance)
    out = rows.groupBy(*keys(symbol), d).agg(F.min_by("open", m).alias("_o"), F.min_by("close", near).alias("_c"))
    return out.select(*keys(symbol), d, change("_c", "_o").alias("horizon_ret"))


def time_of_day_edge(df: DataFrame, bars: int = 1, cond=None, min_n: int = 5, zone: str | None = None, *, symbol="symbol", ts="ts", minute="minute_of_day") -> DataFrame:
    """Per clock time the forward return over n bars (the next bars of the symbol, across days): count, mean, share positive, best, worst; ranked by mean. ``cond`` filters
    rows (for example the direction of another series), ``zone`` keeps the opening or closing hour."""
    # bars are numbered by day and the days' counts before it, so that no window holds all bars of a symbol
    day = F.to_date(ts).alias("_day")
    placed = df.select("*", day).withColumn("_i", F.row_number().over(Window.partitionBy(*keys(symbol), "_day").orderBy(ts)))
    before = Window.partitionBy(*keys(symbol)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys(symbol), day).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = placed.join(counts, [*keys(symbol), "_day"]).withColumn("_i", F.col("_i") + F.col("_before")).drop("_day", "_before")
    later = placed.select(*keys(symbol), (F.col("_i") - bars).alias("_i"), F.col("close").alias("_later"))
    rows = placed.join(later, [*keys(symbol), "_i"], "left").withColumn("_r", change("_later", "close")).drop("_i", "_later")
    if cond is not None:
        rows = rows.filter(truth(cond))
    if zone == "open":
        rows = time_window(rows, "09:30", "10:30", minute=minute)
    elif zone == "close":
        rows = time_window(rows, "15:00", "16:00", minute=minute)
    r = F.col("_r")
    out = rows.filter(r.isNotNull()).groupBy(*keys(symbol), minute).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("positive_rate"), F.max(r).alias("best"), F.min(r).alias("worst"))
    order = Window.partitionBy(*keys(symbol)).orderBy(F.col("mean").desc(), F.col("positive_rate").desc(), F.col("n").desc(), minute)
    return out.filter(F.col("n") >= min_n).withColumn("rank", F.row_number().over(order))


def opening_bucket_by_month(df: DataFrame, minutes: int = 30, *, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """Signed and absolute return of the first minutes after each day's first bar, by calendar month."""
    m = F.col(minute)
    rows = df.withColumn("_first", F.min(m).over(day_window(symbol, d))).filter(m - F.col("_first") < minutes)
    days = rows.groupBy(*keys(symbol), d).agg(change(F.max_by("close", m), F.min_by("open", m)).alias("_r"))
    return days.groupBy(*keys(symbol), F.month(d).alias("month")).agg(F.avg(F.abs("_r")).alias("mean_abs"), F.avg("_r").alias("mean_signed"), F.count(F.lit(1)).alias("n"))


def premarket_inside_prior_range(df: DataFrame, target: DataFrame, tolerance: float = 0.001, *, symbol="symbol", d="d") -> DataFrame:
    """Days whose premarket high and low lie inside the previous day's regular range (touching within the tolerance only if no day
    is strictly inside), and the target's mean opening price on them. ``target`` holds (d, open)."""
    rows = attach_session(df, symbol=symbol, d=d)
    pre, reg = F.col("is_premarket"), F.col("is_regular")
    days = rows.groupBy(*keys(symbol), d).agg(F.max(F.when(pre, F.col("high"))).alias("_ph"), F.min(F.when(pre, F.col("low"))).alias("_pl"),
                                              F.max(F.when(reg, F.col("high"))).alias("_h"), F.min(F.when(reg, F.col("low"))).alias("_l"))
    w = sessions(symbol, d)
    days = days.withColumns({"_h1": F.lag("_h").over(w), "_l1": F.lag("_l").over(w)}).join(target.select(d, F.col("open").alias("_open")), [d])
    slack = (F.col("_h1") - F.col("_l1")) * tolerance
    strict = (F.col("_ph") <= F.col("_h1")) & (F.col("_pl") >= F.col("_l1"))
    touch = (F.col("_ph") <= F.col("_h1") + slack) & (F.col("_pl") >= F.col("_l1") - slack)
    out = days.groupBy(*keys(symbol)).agg(count_where(strict).alias("n_strict"), count_where(touch).alias("n_touch"),
                                          mean_where("_open", strict).alias("_ms"), mean_where("_open", touch).alias("_mt"))
    use = F.col("n_strict") > 0
    return out.select(*keys(symbol), "n_strict", "n_touch", F.when(use, "strict").otherwise("touch").alias("mode"), F.when(use, F.col("_ms")).otherwise(F.col("_mt")).alias("mean_open"))


def premarket_return(df: DataFrame, *, symbol="symbol", d="d", ts="ts") -> DataFrame:
    """Return from the first open to the last close of each session's premarket bars."""
    rows = attach_session(df, symbol=symbol, d=d).filter("is_premarket")
    return rows.groupBy(*keys(symbol), F.col("session_d").alias(d)).agg(change(last_of("close", ts=ts), first_of("open", ts=ts)).alias("ret"), last_of("close", ts=ts).alias("value"))


def window_metric_given_condition(df: DataFrame, start: str, end: str, dates: DataFrame, metric: str = "return", *, symbol="symbol", d="d",
                                  minute="minute_of_day") -> DataFrame:
    """Mean over condition days of the daily mean of a metric (bar return, open or close) between two times, both included."""
    value = {"return": change("close", "open"), "open": F.col("open")}.get(metric, F.col("close"))
    rows = time_window(df, start, end, minute=minute).join(dates, [d], "left_semi")
    days = rows.groupBy(*keys(symbol), d).agg(F.avg(value).alias("_m"))
    return days.groupBy(*keys(symbol)).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("n"))


def point_in_time_next_day(source_dates: DataFrame, target_daily: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """The target's next-session open, close and return after the given days (for example those of B14)."""
    w = sessions(symbol, d)
    t = target_daily.withColumns({"next_open": F.lead("open").over(w), "next_close": F.lead("close").over(w)})
    t = t.withColumn("next_ret", change("next_close", "next_open")).join(source_dates.select(d).distinct(), [d], "left_semi")
    return t.select(*keys(symbol), d, "next_open", "next_close", "next_ret")


def conditional_session_stats(entries: DataFrame, cond, min_n: int = 5, *, symbol="symbol") -> DataFrame:
    """Per horizon the share of positive moves, mean and median on the sessions of a condition (for example on ``gap_pct``)."""
    r = F.col("ret_pct")
    out = entries.filter(truth(cond) & r.isNotNull()).groupBy(*keys(symbol), "horizon").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.when(r > 0, 1.0).otherwise(0.0)) * 100.0).alias("pct_positive"), F.avg(r).alias("mean"), median(r).alias("median"))
    return out.filter(F.col("n") >= min_n)


def opening_bar_features(df: DataFrame, *, symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """The first bar of each day: time, prices, return, range over open, direction."""
    m = F.col(minute)
    out = df.groupBy(*keys(symbol), d).agg(F.min(m).alias("minute"), *[F.min_by(c, m).alias(c) for c in ("open", "high", "low", "close")])
    return out.withColumns({"open_bar_ret": change("close", "open"), "open_bar_range": F.try_divide(F.col("high") - F.col("low"), F.col("open")),
                            "open_bar_direction": F.signum(F.col("close") - F.col("open")).cast("int")})
