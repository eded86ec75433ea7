"""Candlestick and sequence patterns and what followed them.

Signals are rows of a bar table. Leads and lags are taken on the full series before any filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (all_of, any_of, as_col, bucket, change_pct, color, count_where, mean_where, median, ratio, truth)
from ..functions.windows import keys, rolling, sessions, whole
from .filters import exclude_event_window
from .joins import spread_nearest
from .series import forward_closes, returns, volume_features

BEARISH, BULLISH = "bearish", "bullish"


def unpivot(df: DataFrame, ids, groups: dict, names) -> DataFrame:
    """Long form of grouped aggregate columns: one row per key of ``groups``, whose value lists the
    columns that become ``names``; the key becomes the first name."""
    rows = F.array(*[F.struct(F.lit(key).alias(names[0]), *[F.col(c).alias(n) for c, n in zip(cols, names[1:])])
                     for key, cols in groups.items()])
    return df.select(*ids, F.inline(rows))


def engulfing(df: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """``bearish_engulfing`` and ``bullish_engulfing``: the previous bar has the opposite colour, the
    body covers the previous body (touching counts) and is larger."""
    w = sessions(symbol, d)
    o, c = F.col("open"), F.col("close")
    po, pc = F.lag("open").over(w), F.lag("close").over(w)
    larger = F.abs(c - o) > F.abs(pc - po)
    return df.withColumns({
        "bearish_engulfing": truth((pc > po) & (c < o) & (o >= pc) & (c <= po) & larger),
        "bullish_engulfing": truth((pc < po) & (c > o) & (o <= pc) & (c >= po) & larger)})


def engulfing_strict(df: DataFrame, side: str = BEARISH, earnings: DataFrame | None = None, buffer: int = 5,
                     min_overlap: float = 0.01, body_factor: float = 1.1, *, symbol="symbol", d="d") -> DataFrame:
    """Engulfing by at least 0.01 at both ends with a body 1.1 times the previous one and no less
    volume, away from earnings. Adds var_j, vol_ratio and body_ratio."""
    w = sessions(symbol, d)
    out = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("open", "close", "volume")})
    o, c, po, pc = F.col("open"), F.col("close"), F.col("prev_open"), F.col("prev_close")
    body, prev_body = F.abs(c - o), F.abs(pc - po)
    if side == BEARISH:
        shape = (pc > po) & (c < o) & (o - pc >= min_overlap) & (po - c >= min_overlap)
    else:
        shape = (pc < po) & (c > o) & (pc - o >= min_overlap) & (c - po >= min_overlap)
    thin = truth((F.col("prev_volume") > 0) & (F.col("volume") < F.col("prev_volume")))
    # the derived columns are added before the filter so that later windows keep whole series
    out = out.withColumns({"var_j": change_pct(c, F.when(pc > 0, pc)),
                           "vol_ratio": ratio("volume", F.when(F.col("prev_volume") > 0, F.col("prev_volume"))),
                           "body_ratio": ratio(body, F.when(prev_body > 0, prev_body))})
    out = out.filter(shape & (body >= prev_body * body_factor) & ~thin)
    return out if earnings is None else exclude_event_window(out, earnings, buffer, buffer, symbol=symbol, d=d)


# Names of the candle patterns.
CANDLE_FLAGS = ["bearish_engulfing", "bullish_engulfing", "two_red", "two_green", "two_red_body_engulf", "doji", "hammer",
                "shooting_star", "inside_bar", "outside_bar", "three_black_crows", "three_white_soldiers", "morning_star",
                "evening_star"]


def candle_patterns(df: DataFrame, *, symbol="symbol", order="d") -> DataFrame:
    """The pattern flags of each bar (body-high/low engulfing form). Rows without full OHLC are dropped."""
    w = sessions(symbol, order)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    full = df.filter(o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull())
    full = full.withColumns({"_c": color(), "_bh": F.greatest(o, c), "_bl": F.least(o, c)})
    lag = {f"_c{n}": F.lag("_c", n).over(w) for n in (1, 2)}
    full = full.withColumns(lag | {"_pbh": F.lag("_bh").over(w), "_pbl": F.lag("_bl").over(w),
                                   "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w)})
    red, green = F.col("_c") == -1, F.col("_c") == 1
    red1, green1, red2, green2 = F.col("_c1") == -1, F.col("_c1") == 1, F.col("_c2") == -1, F.col("_c2") == 1
    engulfs = (F.col("_bh") >= F.col("_pbh")) & (F.col("_bl") <= F.col("_pbl"))
    body, span = F.abs(c - o), F.abs(h - l)
    upper, lower = h - F.col("_bh"), F.col("_bl") - l
    flags = {
        "bearish_engulfing": red & green1 & engulfs, "bullish_engulfing": green & red1 & engulfs,
        "two_red": red & red1, "two_green": green & green1, "two_red_body_engulf": red & red1 & engulfs,
        "doji": (span > 0) & (body / F.nullif(span, F.lit(0.0)) <= 0.10),
        "hammer": (lower >= body * 2.0) & (upper <= body), "shooting_star": (upper >= body * 2.0) & (lower <= body),
        "inside_bar": (h <= F.col("_ph")) & (l >= F.col("_pl")), "outside_bar": (h >= F.col("_ph")) & (l <= F.col("_pl")),
        "three_black_crows": red & red1 & red2, "three_white_soldiers": green & green1 & green2,
        "morning_star": green & red2, "evening_star": red & green2}
    return full.withColumns({k: truth(v) for k, v in flags.items()}).drop("_c", "_bh", "_bl", "_c1", "_c2", "_pbh", "_pbl", "_ph", "_pl")


def next_moves(df: DataFrame, *, symbol="symbol", order="d", d="d") -> DataFrame:
    """Adds next_bar_ret (next open to next close) and next_day_ret (the same for the next day)."""
    w = sessions(symbol, order)
    no, nc = F.lead("open").over(w), F.lead("close").over(w)
    out = df.withColumn("next_bar_ret", F.try_divide(nc - no, no))
    if order == d:
        return out.withColumn("next_day_ret", F.col("next_bar_ret"))
    day = df.groupBy(*keys(symbol), d).agg(F.min_by("open", order).alias("_o"), F.max_by("close", order).alias("_c"))
    wd = sessions(symbol, d)
    day = day.select(*keys(symbol), d, F.try_divide(F.lead("_c").over(wd) - F.lead("_o").over(wd), F.lead("_o").over(wd)).alias("next_day_ret"))
    return out.join(day, [*keys(symbol), d], "left")


def pattern_next_stats(df: DataFrame, flags=tuple(CANDLE_FLAGS), horizon: str = "next_bar", *, symbol="symbol", order="d", d="d") -> DataFrame:
    """Per symbol and pattern: count, share followed by a rise, mean next move. All patterns come out
    of one aggregation; a missing next move counts as "not positive", as in the share of all hits."""
    ret = f"{horizon}_ret"
    rows = next_moves(df, symbol=symbol, order=order, d=d)
    aggs, groups = [], {}
    for f in flags:
        hit = F.col(f)
        aggs += [count_where(hit).alias(f"n_{f}"), count_where(hit & (F.col(ret) > 0)).alias(f"p_{f}"), mean_where(ret, hit).alias(f"m_{f}")]
        groups[f] = (f"n_{f}", f"p_{f}", f"m_{f}")
    wide = rows.groupBy(*keys(symbol)).agg(*aggs)
    out = unpivot(wide, keys(symbol), groups, ["pattern", "n", "n_positive", "mean_next"])
    return out.withColumn("prob_positive", F.try_divide(F.col("n_positive").cast("double"), "n"))


COLORS = {"red": -1, "green": 1, "flat": 0}


def color_sequence(df: DataFrame, colors, *, name="sequence", symbol="symbol", order="d") -> DataFrame:
    """E5: true where the last bars up to this one have the given colours, oldest first."""
    w = sessions(symbol, order)
    out = df.withColumn("_c", color())
    steps = [F.lag("_c", len(colors) - 1 - i).over(w) == COLORS[x] for i, x in enumerate(colors)]
    return out.withColumn(name, truth(all_of(steps))).drop("_c")


def sequence_next_mean(df: DataFrame, colors, years=None, *, symbol="symbol", order="d", d="d", full="full_candle") -> DataFrame:
    """A colour sequence of closed candles only and the mean next-bar return (close to close)."""
    w = sessions(symbol, order)
    closed = F.col(full) if full in df.columns else F.lit(True)
    rows = df.withColumns({"_c": F.when(closed, color()), "_next": change_pct(F.lead("close").over(w), "close") / 100.0})
    rows = rows.withColumn("_hit", truth(all_of([F.lag("_c", len(colors) - 1 - i).over(w) == COLORS[x] for i, x in enumerate(colors)])))
    if years:
        rows = rows.filter(F.year(d).isin(list(years)))
    return rows.filter("_hit").groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("n"), F.avg("_next").alias("mean_next"))


def engulfing_signals(df: DataFrame, side: str = BEARISH, earnings: DataFrame | None = None, horizon: int = 5, *,
                      symbol="symbol", d="d") -> DataFrame:
    """E1 signals with returns, volume ratio and forward prices, away from earnings."""
    rows = forward_closes(returns(volume_features(df, symbol=symbol, d=d), symbol=symbol, d=d), horizon, symbol=symbol, d=d, with_high=True)
    out = engulfing(rows, symbol=symbol, d=d).filter(f"{side}_engulfing")
    return out if earnings is None else exclude_event_window(out, earnings, symbol=symbol, d=d)


def best_price(horizon: int, side: str, basis: str | None = None) -> Column:
    """The most favourable price over the next sessions; missing sessions are skipped.

    ``basis``: close, extreme (low for bearish, high for bullish) or both. The default is both for bearish
    and close for bullish signals.
    """
    basis = basis or ("both" if side == BEARISH else "close")
    edge = "low" if side == BEARISH else "high"
    kinds = {"close": ["close"], "extreme": [edge], "both": ["close", edge]}[basis]
    cols = [F.col(f"{k}_j{h}") for k in kinds for h in range(1, horizon + 1)]
    if len(cols) == 1:
        return cols[0]
    return F.least(*cols) if side == BEARISH else F.greatest(*cols)


def reaches(price, pct, side: str, strict: bool = False, close="close") -> Column:
    """The price is at or beyond (strictly beyond) the close moved by ``pct`` in the signal's direction."""
    pct = pct if isinstance(pct, Column) else F.lit(float(pct))
    price, close = as_col(price), as_col(close)
    if side == BEARISH:
        level = close * (F.lit(1.0) - pct / 100.0)
        return price < level if strict else price <= level
    level = close * (F.lit(1.0) + pct / 100.0)
    return price > level if strict else price >= level


def engulfing_outcome(signals: DataFrame, side: str = BEARISH, horizon: int = 5, threshold_pct: float = 2.0,
                      basis: str | None = None, strict: bool = False) -> DataFrame:
    """``success`` if a price of J+1..J+h passes the close moved by the threshold; ``best_perf`` is the signed
    best change and ``best_move`` its size in the signal's direction, at least 0."""
    best = best_price(horizon, side, basis)
    perf = change_pct(best, "close")
    move = F.greatest(F.coalesce(-perf if side == BEARISH else perf, F.lit(0.0)), F.lit(0.0))
    return signals.withColumns({"success": truth(reaches(best, threshold_pct, side, strict)), "best_perf": perf, "best_move": move})


def threshold_curve(signals: DataFrame, side: str = BEARISH, thresholds=None, target: float = 70.0, horizon: int = 5,
                    basis: str | None = None, *, symbol="symbol") -> DataFrame:
    """Success rate per threshold (0.5 to 15 % by 0.5) and the first threshold that meets the target.

    All thresholds are conditional counts of one aggregation, so signals are never multiplied.
    """
    thresholds = thresholds or [x / 2 for x in range(1, 31)]
    best = best_price(horizon, side, basis)
    aggs = [F.count(F.lit(1)).alias("n_total")] + [count_where(reaches(best, t, side)).alias(f"t{i}") for i, t in enumerate(thresholds)]
    wide = signals.groupBy(*keys(symbol)).agg(*aggs)
    out = unpivot(wide, [*keys(symbol), "n_total"], {float(t): (f"t{i}",) for i, t in enumerate(thresholds)}, ["threshold", "n_success"])
    out = out.withColumn("rate", ratio("n_success", "n_total") * 100.0)
    return mark_first(out, F.col("rate") >= target, "threshold", symbol)


def mark_first(df: DataFrame, cond, order, symbol="symbol", name="target_met") -> DataFrame:
    """Marks the first row per symbol, by ``order``, on which a condition holds."""
    first = F.min(F.when(cond, F.col(order))).over(whole(symbol))
    return df.withColumn(name, truth(F.col(order) == first))


def outcome_by_bucket(signals: DataFrame, context: DataFrame, edges=(0, 15, 20, 25, 30, 100), *, value="close", symbol="symbol", d="d") -> DataFrame:
    """Success by left-closed range of another series on the signal day; every range is reported."""
    rows = signals.join(context.select(d, F.col(value).alias("_v")), [d]).withColumn("_b", bucket("_v", edges))
    labels = [f"{lo:g}-{hi:g}" for lo, hi in zip(edges, edges[1:])]
    aggs, groups = [], {}
    for i, label in enumerate(labels):
        aggs += [count_where(F.col("_b") == label).alias(f"n{i}"), count_where((F.col("_b") == label) & F.col("success")).alias(f"s{i}")]
        groups[label] = (f"n{i}", f"s{i}")
    out = unpivot(rows.groupBy(*keys(symbol)).agg(*aggs), keys(symbol), groups, ["bucket", "n", "n_success"])
    return out.withColumn("rate", F.coalesce(ratio("n_success", "n") * 100.0, F.lit(0.0)))


def outcome_by_year(signals: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """Signals, successes, failures and rate per year, with a total row (null year) and the best and
    worst year marked (the earliest on ties)."""
    sym = keys(symbol)
    out = (signals.withColumn("year", F.year(d)).groupingSets([[*map(F.col, sym), F.col("year")], [*map(F.col, sym)]], *sym, "year")
           .agg(F.count(F.lit(1)).alias("n"), count_where("success").alias("n_success")))
    out = out.withColumns({"n_fail": F.col("n") - F.col("n_success"), "rate": ratio("n_success", "n") * 100.0})
    known = F.col("year").isNotNull()
    best = F.max(F.when(known, F.struct(F.col("rate"), -F.col("year")))).over(whole(symbol))
    worst = F.min(F.when(known, F.struct("rate", "year"))).over(whole(symbol))
    return out.withColumns({"is_best": known & (F.struct(F.col("rate"), -F.col("year")) == best),
                            "is_worst": known & (F.struct("rate", "year") == worst)})


def outcome_multi_period(signals: DataFrame, years, *, symbol="symbol", d="d") -> DataFrame:
    """The outcome of the given years side by side."""
    return (signals.filter(F.year(d).isin(list(years))).groupBy(*keys(symbol), F.year(d).alias("year"))
            .agg(F.count(F.lit(1)).alias("n"), count_where("success").alias("n_success"))
            .withColumn("rate", ratio("n_success", "n") * 100.0))


def volume_gate_curve(signals: DataFrame, quantiles=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), min_n: int = 5,
                      target: float = 70.0, *, symbol="symbol") -> DataFrame:
    """Success rate among signals whose volume ratio reaches each of its quantiles; the first gate that
    meets the target is marked."""
    sym = keys(symbol)
    gates = signals.groupBy(*sym).agg(F.percentile("vol_ratio", F.array(*[F.lit(q) for q in quantiles])).alias("_q"))
    rows = signals.join(gates, sym)
    aggs, groups = [], {}
    for i, q in enumerate(quantiles):
        hit = F.col("vol_ratio") >= F.col("_q")[i]
        aggs += [F.first(F.col("_q")[i]).alias(f"g{i}"), count_where(hit).alias(f"n{i}"), count_where(hit & F.col("success")).alias(f"s{i}")]
        groups[float(q)] = (f"g{i}", f"n{i}", f"s{i}")
    out = unpivot(rows.groupBy(*sym).agg(*aggs), sym, groups, ["quantile", "min_vol_ratio", "n", "n_success"])
    out = out.filter(F.col("n") >= min_n).withColumn("rate", ratio("n_success", "n") * 100.0)
    return mark_first(out, F.col("rate") >= target, "quantile", symbol)


def move_duration(signals: DataFrame, side: str = BEARISH, horizon: int = 5) -> DataFrame:
    """``days``: how many sessions in a row closed beyond the signal's close."""
    beyond = [truth(F.col(f"close_j{h}") < F.col("close")) if side == BEARISH else truth(F.col(f"close_j{h}") > F.col("close"))
              for h in range(1, horizon + 1)]
    days = F.lit(0)
    for h in range(horizon, 0, -1):
        days = F.when(beyond[h - 1], days + 1).otherwise(F.lit(0))
    return signals.withColumn("days", days)


def duration_summary(durations: DataFrame, *, symbol="symbol") -> DataFrame:
    """Count, median and mean of the durations."""
    return durations.groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("n"), median("days").alias("median_days"), F.avg("days").alias("mean_days"))


def duration_distribution(durations: DataFrame, *, symbol="symbol") -> DataFrame:
    return durations.groupBy(*keys(symbol), "days").agg(F.count(F.lit(1)).alias("n"))


def after_signal_perf(signals: DataFrame, *, symbol="symbol") -> DataFrame:
    """Next-session move after the signals."""
    nv = F.col("next_var")
    return signals.filter(nv.isNotNull()).groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(nv).alias("avg_next"), median(nv).alias("med_next"),
        (F.avg(F.when(nv > 0, 1.0).otherwise(0.0)) * 100.0).alias("pct_pos_next"))


def failure_context(signals: DataFrame, market: DataFrame, tolerance_days: int = 2, *, symbol="symbol", series="series", d="d") -> DataFrame:
    """For each market series the mean level at failed and at successful signals (nearest value within two
    days) and whether they differ by more than half the deviation at successes."""
    near = spread_nearest(market, tolerance_days, by=series, d=d)
    rows = signals.select(*keys(symbol), d, "success").join(near, [d])
    v, ok = F.col("value"), F.col("success")
    out = rows.groupBy(*keys(symbol), series).agg(
        count_where(~ok).alias("n_fail"), count_where(ok).alias("n_success"), mean_where(v, ~ok).alias("mean_fail"),
        mean_where(v, ok).alias("mean_success"), F.stddev_samp(F.when(ok, v)).alias("std_success"))
    out = out.filter((F.col("n_fail") >= 2) & (F.col("n_success") >= 2))
    std = F.when(F.col("std_success") > 0, F.col("std_success")).otherwise(1.0)
    diff = F.col("mean_fail") - F.col("mean_success")
    return out.withColumns({"diff": diff, "notable": F.abs(diff) > std * 0.5})


def failure_profile(signals: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """Volume ratios and the most frequent weekday and month of failed signals (smallest on ties)."""
    ok = F.col("success")
    return signals.groupBy(*keys(symbol)).agg(
        count_where(~ok).alias("n_fail"), mean_where("vol_ratio", ~ok).alias("vol_ratio_fail"), mean_where("vol_ratio", ok).alias("vol_ratio_success"),
        F.mode(F.when(~ok, F.weekday(d)), True).alias("weekday_fail"), F.mode(F.when(~ok, F.month(d)), True).alias("month_fail"))


def signal_last(signals: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """The last signal per symbol and the number of signals."""
    return signals.groupBy(*keys(symbol)).agg(F.max(d).alias("last_d"), F.max_by("close", d).alias("close"), F.max_by("var_pct", d).alias("var_pct"),
                                              F.max_by("next_var", d).alias("next_var"), F.count(F.lit(1)).alias("n_total"))


def signal_count(df: DataFrame, cond, *, symbol="symbol") -> DataFrame:
    """Signals, sessions, their share, and the share of signals followed by a fall."""
    hit, nv = truth(cond), F.col("next_var")
    out = df.groupBy(*keys(symbol)).agg(count_where(hit).alias("n"), F.count(F.lit(1)).alias("total"),
                                        count_where(hit & (nv < 0)).alias("_neg"), count_where(hit & nv.isNotNull()).alias("_known"))
    return out.withColumns({"pct": ratio("n", "total") * 100.0, "pct_neg_next": ratio("_neg", "_known") * 100.0}).drop("_neg", "_known")


def forward_low_columns(horizons, w) -> dict:
    """Close, close return and lowest-low return to J+h, null while J+h does not exist."""
    cols = {}
    for h in horizons:
        ch = F.lead("close", h).over(w)
        lowest = F.when(ch.isNotNull(), F.min("low").over(w.rowsBetween(1, h)))
        cols[f"close_j{h}"] = ch
        cols[f"return_close_j{h}_pct"] = change_pct(ch, "close")
        cols[f"return_lowmin_j{h}_pct"] = change_pct(lowest, "close")
    return cols


def bbe_signal_table(bars: DataFrame, earnings: DataFrame | None = None, horizons=(1, 2, 3, 4, 5), min_rows: int = 30,
                     side: str = BEARISH, *, symbol="symbol", d="d") -> DataFrame:
    """Strict engulfing signals of every ticker with at least ``min_rows`` bars and a next session."""
    w = sessions(symbol, d)
    rows = bars.filter(F.col("open").isNotNull() & F.col("close").isNotNull())
    rows = rows.withColumns(forward_low_columns(horizons, w) | {"_rows": F.count(F.lit(1)).over(whole(symbol))})
    out = engulfing_strict(rows, side, earnings, symbol=symbol, d=d)
    out = out.filter((F.col("_rows") >= min_rows) & F.col(f"close_j{min(horizons)}").isNotNull() & (F.col("close") > 0))
    return out.select(*keys(symbol), d, F.col("close").alias("close_j0"), *list(forward_low_columns(horizons, w)))


def rank_tickers(signals: DataFrame, dim: DataFrame | None = None, horizon: int = 5, threshold_pct: float = -2.0, basis: str = "lowmin",
                 min_signals: int = 0, sectors=None, *, symbol="symbol") -> DataFrame:
    """Per ticker the number, mean, median, worst and best return, win rate (at or below the threshold) and
    fails; ranked by win rate, then signals, then ticker."""
    r = F.col(f"return_{basis}_j{horizon}_pct")
    out = signals.filter(r.isNotNull()).groupBy(symbol).agg(
        F.count(F.lit(1)).alias("n_signals"), F.avg(r).alias("mean_ret"), median(r).alias("median_ret"), F.min(r).alias("worst"),
        F.max(r).alias("best"), (F.avg(F.when(r <= threshold_pct, 1.0).otherwise(0.0)) * 100.0).alias("win_rate"),
        count_where(r > threshold_pct).alias("fails"))
    if dim is not None:
        out = out.join(dim, symbol, "left")
    out = out.filter(F.col("n_signals") >= min_signals)
    if sectors:
        out = out.filter(F.col("sector").isin(list(sectors)))
    return add_rank(out, [F.col("win_rate").desc(), F.col("n_signals").desc(), F.col(symbol).asc()])


def rank_tickers_next_day(signals: DataFrame, tickers: DataFrame, *, symbol="symbol") -> DataFrame:
    """Ranking by the mean next-session return, most negative first; tickers without signals last."""
    r = F.col("return_close_j1_pct")
    stats = signals.filter(r.isNotNull()).groupBy(symbol).agg(
        F.count(F.lit(1)).alias("n_signals"), F.avg(r).alias("j1_mean"), median(r).alias("j1_median"),
        (F.avg(F.when(r < 0, 1.0).otherwise(0.0)) * 100.0).alias("hit_rate"), F.min(r).alias("j1_worst"), F.max(r).alias("j1_best"))
    out = tickers.select(symbol).distinct().join(stats, symbol, "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))
    return add_rank(out, [F.col("j1_mean").asc_nulls_last(), F.col("n_signals").desc(), F.col(symbol).asc()])


def add_rank(df: DataFrame, order, name="rank") -> DataFrame:
    """Row number over one table of at most one row per ticker."""
    from pyspark.sql import Window
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def signals_in_week(bars: DataFrame, monday, earnings: DataFrame | None = None, history: DataFrame | None = None,
                    threshold_pct: float = -2.0, *, symbol="symbol", d="d") -> DataFrame:
    """The signals of one week with the next session's move and the lowest low to J+5 as far as known,
    next to the ticker's historic win rates."""
    w = sessions(symbol, d)
    start = F.lit(monday).cast("date")
    rows = bars.filter(F.col("open").isNotNull() & F.col("close").isNotNull()).withColumns({
        "return_close_j1_pct": change_pct(F.lead("close").over(w), "close"),
        "return_lowmin_j5_pct": change_pct(F.min("low").over(w.rowsBetween(1, 5)), "close")})
    week = engulfing_strict(rows, BEARISH, earnings, symbol=symbol, d=d).filter(F.col(d).between(start, F.date_add(start, 6)))
    week = week.select(symbol, d, F.col("close").alias("close_j0"), "return_close_j1_pct", "return_lowmin_j5_pct")
    if history is None:
        return week
    rates = history.groupBy(symbol).agg(*[
        (F.avg(F.when(F.col(f"return_lowmin_j{h}_pct") <= threshold_pct, 1.0).when(F.col(f"return_lowmin_j{h}_pct").isNotNull(), 0.0)) * 100.0)
        .alias(f"win_rate_j{h}") for h in (1, 5)])
    return week.join(rates, symbol, "left").fillna(0.0, ["win_rate_j1", "win_rate_j5"])


def engulfing_filtered(df: DataFrame, side: str = BEARISH, *, earnings: DataFrame | None = None, vix: DataFrame | None = None,
                       require_gap: bool = False, min_body_pct: float = 0.0, ma20: bool = False, vol_ma20: bool = False,
                       vix_min: float = 0.0, rsi_min: float | None = None, horizon: int = 5, threshold_pct: float = 2.0,
                       symbol="symbol", d="d") -> DataFrame:
    """Engulfing with optional gates, its best move over J+1..J+h (lows for bearish, highs for bullish)
    and whether it reaches the threshold. Gates on missing values pass. ``evaluable`` is false without a
    later session."""
    w = sessions(symbol, d)
    edge = "low" if side == BEARISH else "high"
    ahead = w.rowsBetween(1, horizon)
    agg = F.min if side == BEARISH else F.max
    rows = df.withColumns({"_po": F.lag("open").over(w), "_pc": F.lag("close").over(w), "_pv": F.lag("volume").over(w),
                           "_ma20": rolling("mean", "close", w, 20), "_vma20": rolling("mean", "volume", w, 20),
                           "_edge": agg(edge).over(ahead), "_close": agg("close").over(ahead)}
                          | ({"_prsi": F.lag("rsi").over(w)} if "rsi" in df.columns else {}))
    o, c, h, l, po, pc = (F.col(x) for x in ("open", "close", "high", "low", "_po", "_pc"))
    body, prev_body, span = F.abs(c - o), F.abs(pc - po), h - l
    reject = [(F.col("_pv") > 0) & (F.col("volume") < F.col("_pv"))]
    if side == BEARISH:
        shape = (pc > po) & (c < o) & (c < po)
        if require_gap:
            reject.append(o < pc * 0.999)
        if ma20:
            reject.append(c > F.col("_ma20"))
        if rsi_min is not None and "rsi" in df.columns:
            reject.append(F.col("_prsi") < rsi_min)
    else:
        # a bullish signal always needs the opening within the gap tolerance
        shape = (pc < po) & (c > o) & (c > po) & (o <= pc * 1.001)
    if min_body_pct > 0:
        reject.append((span > 0) & (body / F.nullif(span, F.lit(0.0)) * 100.0 < min_body_pct))
    if vol_ma20:
        reject.append(F.col("volume") < F.col("_vma20"))
    out = rows.filter(shape & (body >= prev_body * 1.1) & ~truth(any_of([truth(x) for x in reject])))
    if side == BEARISH and vix_min > 0 and vix is not None:
        levels = vix.select(d, F.col("open").alias("_vix"))
        out = out.join(levels, [d], "left").filter(~truth(F.col("_vix") < vix_min))
    if earnings is not None:
        out = exclude_event_window(out, earnings, symbol=symbol, d=d)
    best = F.least("_edge", "_close") if side == BEARISH else F.greatest("_edge", "_close")
    return out.select(*keys(symbol), d, "close", change_pct(c, F.when(pc > 0, pc)).alias("var_j"),
                      ratio("volume", F.when(F.col("_pv") > 0, F.col("_pv"))).alias("vol_ratio"),
                      ratio(body, F.when(prev_body > 0, prev_body)).alias("body_ratio"), change_pct(best, "close").alias("best_perf"),
                      best.isNotNull().alias("evaluable"), truth(reaches(best, threshold_pct, side)).alias("success"))


def win_rate(signals: DataFrame, *, symbol="symbol") -> DataFrame:
    """Wins among the evaluable signals."""
    out = signals.groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("n_signals"), count_where("evaluable").alias("n_evaluable"),
                                             count_where(F.col("evaluable") & F.col("success")).alias("n_win"))
    return out.withColumn("win_rate", F.coalesce(ratio("n_win", "n_evaluable") * 100.0, F.lit(0.0)))


def signal_index_context(signals: DataFrame, index_bars: DataFrame, *, d="d") -> DataFrame:
    """The index's return on its sessions before, on and after each signal day; null when the index
    did not trade on the day. ``index_bars`` holds one series."""
    w = sessions("symbol", d)
    r = index_bars.select("symbol", d, change_pct("close", F.lag("close").over(w)).alias("index_j0"))
    r = r.select(d, "index_j0", F.lag("index_j0").over(w).alias("index_jm1"), F.lead("index_j0").over(w).alias("index_j1"))
    return signals.join(r, [d], "left")
