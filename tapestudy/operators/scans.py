"""Pattern scans over many named conditions.

Named conditions are evaluated once per row and spread only where they hold, so the long form carries matches, not candidates.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import (
    all_of, change, change_pct, color, contains_any, count_where, mean_where, median, ratio, truth,
)
from ..functions.windows import keys, rolling, rolling_percentile, sessions, whole
from .candles import engulfing, unpivot
from .series import forward_closes, returns, streak, volume_features


def spread_matches(df: DataFrame, conditions: dict[str, Column], name="signal") -> DataFrame:
    """One row per row and condition that holds; the position in the mapping is kept."""
    hits = F.array_compact(F.array(*[F.when(truth(c), F.struct(F.lit(i).alias("position"), F.lit(k).alias(name))) for i, (k, c) in enumerate(conditions.items())]))
    return df.select("*", F.inline(hits))


def best_ranks(ranked: DataFrame, top: int | None) -> DataFrame:
    """All ranks, or the first ``top`` where the caller asks for a cut."""
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def test_signals(matches: DataFrame, target="overnight", min_n: int = 20, min_median: float = 0.15, min_is: float = 55.0, min_oos: float = 48.0,
                 is_ratio: float = 0.7, min_oos_n: int = 6, *, symbol="symbol", d="d", name="signal") -> DataFrame:
    """The first 70 % of a signal's matches against the rest: share of rises, median, kept by size, median and rates; ``actionable``
    at 70 / 55 %. ``matches`` holds (symbol, d, signal, target) rows."""
    rows = matches.filter(F.col(target).isNotNull())
    w = Window.partitionBy(*keys(symbol), name)
    rows = rows.withColumns({"_rn": F.row_number().over(w.orderBy(d)), "_n": F.count(F.lit(1)).over(w)})
    inside = F.col("_rn") <= F.floor(F.col("_n") * is_ratio)
    up = F.when(F.col(target) > 0, 100.0).otherwise(0.0)
    out = rows.groupBy(*keys(symbol), name).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(inside, up)).alias("rate_is"), F.avg(F.when(~inside, up)).alias("_oos"), count_where(~inside).alias("n_oos"),
        median(target).alias("median_amp"), F.max(d).alias("last_d"))
    out = out.withColumn("rate_oos", F.when(F.col("n_oos") >= min_oos_n, F.col("_oos"))).drop("_oos")
    out = out.filter((F.col("n") >= min_n) & (F.abs("median_amp") >= min_median) & (F.col("rate_is") >= min_is) & (F.col("rate_oos").isNull() | (F.col("rate_oos") >= min_oos)))
    return out.withColumns({"direction": F.when(F.col("median_amp") > 0, "up").otherwise("down"),
                            "actionable": (F.col("rate_is") >= 70) & (F.coalesce("rate_oos", F.lit(0.0)) >= 55)})


def overnight_signals(df: DataFrame, *, symbol="symbol", d="d") -> tuple[DataFrame, dict[str, Column]]:
    """The named signals of the overnight scan. ``df`` holds bars and, where known, the day's vix, vix1d_ratio, vvix and skew levels and calendar
    columns (is_opex, days_to_opex, days_since_opex, is_fomc, is_cpi, is_nfp, is_high_impact, is_earnings_top2, is_low_activity, macro_surprise)."""
    w = sessions(symbol, d)
    c = F.col("close")
    out = df.withColumns({
        "overnight": change_pct(F.lead("open").over(w), c), "_gap": change_pct("open", F.lag("close").over(w)), "_ma20": rolling("mean", c, w, 20),
        "_m1": change_pct(c, F.lag(c, 21).over(w)), "_m3": change_pct(c, F.lag(c, 63).over(w)), "_m6": change_pct(c, F.lag(c, 126).over(w)),
        "_hi": rolling("max", c, w, 252, 50), "_lo": rolling("min", c, w, 252, 50)})
    have = set(df.columns)
    if "vvix" in have:
        out = out.withColumns({"_v90": rolling_percentile("vvix", 0.90, w, 252, 50), "_v10": rolling_percentile("vvix", 0.10, w, 252, 50)})
    if "is_fomc" in have:
        out = out.withColumn("_fomc_next", F.lead("is_fomc").over(w))
    col = F.col
    s: dict[str, Column] = {}
    if "vix" in have:
        s |= {"vix > 25": col("vix") > 25, "vix > 20": col("vix") > 20, "vix < 15": col("vix") < 15}
    if "vix1d_ratio" in have:
        s |= {"vix1d/vix > 1.20": col("vix1d_ratio") > 1.20, "vix1d/vix < 0.85": col("vix1d_ratio") < 0.85}
    if "vvix" in have:
        s |= {"vvix > p90": col("vvix") > col("_v90"), "vvix < p10": col("vvix") < col("_v10")}
    if "skew" in have:
        s |= {"skew > 140": col("skew") > 140, "skew < 100": col("skew") < 100}
    s |= {"gap < -1": col("_gap") < -1.0, "gap > 1": col("_gap") > 1.0, "below ma20": c < col("_ma20"), "mom 1m > 0": col("_m1") > 0, "mom 1m < 0": col("_m1") < 0,
          "mom 3m > 0": col("_m3") > 0, "mom 6m > 0": col("_m6") > 0, "near 52w high": F.try_divide(col("_hi") - c, col("_hi")) < 0.02,
          "near 52w low": F.try_divide(c - col("_lo"), col("_lo")) < 0.02}
    if "is_opex" in have:
        s["opex day"] = col("is_opex")
        s["opex week"] = (F.coalesce("days_to_opex", F.lit(999)) <= 2) | (F.coalesce("days_since_opex", F.lit(999)) <= 2)
    if "is_fomc" in have:
        s |= {"fomc day": col("is_fomc"), "fomc eve": col("_fomc_next")}
    for name in ("is_cpi", "is_nfp", "is_high_impact"):
        if name in have:
            s[name[3:] + " day"] = col(name)
    if "is_high_impact" in have:
        s["no high impact"] = ~truth("is_high_impact")
    for name in ("is_earnings_top2", "is_low_activity"):
        if name in have:
            s[name[3:]] = col(name)
    if "macro_surprise" in have:
        s |= {"surprise > 1": col("macro_surprise") > 1.0, "surprise < -1": col("macro_surprise") < -1.0}
    return out, s


def overnight_signal_scan(df: DataFrame, max_pairs: int | None = None, *, symbol="symbol", d="d", **limits) -> DataFrame:
    """All single signals and all passing pairs (``max_pairs``: only the first ones in declared order). A row's pairs are formed from its own list of
    signals, without a self-join."""
    rows, signals = overnight_signals(df, symbol=symbol, d=d)
    rows = rows.filter(F.col("overnight").isNotNull())
    newest = F.max(d).over(whole(symbol))
    hits = F.array_compact(F.array(*[F.when(truth(c), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"))) for i, (k, c) in enumerate(signals.items())]))
    rows = rows.select(*keys(symbol), d, "overnight", newest.alias("_newest"), hits.alias("_h"))
    pairs = F.flatten(F.transform("_h", lambda a: F.transform(F.filter("_h", lambda b: b["i"] > a["i"]), lambda b: F.struct(
        (a["i"] * 1000 + b["i"]).alias("i"), F.concat(a["k"], F.lit(" + "), b["k"]).alias("k")))))
    singles = rows.select(*keys(symbol), d, "overnight", "_newest", F.inline("_h"), F.lit("single").alias("kind"))
    doubles = rows.select(*keys(symbol), d, "overnight", "_newest", F.inline(pairs), F.lit("pair").alias("kind"))
    matches = singles.unionByName(doubles).withColumn("signal", F.col("k"))
    tested = test_signals(matches, symbol=symbol, d=d, **limits)
    info = matches.groupBy(*keys(symbol), "signal").agg(F.max("kind").alias("kind"), F.max("i").alias("position"), F.max("_newest").alias("_newest"))
    out = tested.join(info, [*keys(symbol), "signal"]).withColumn("active_today", F.col("last_d") == F.col("_newest"))
    if max_pairs is not None:
        order = Window.partitionBy(*keys(symbol), "kind").orderBy("position")
        out = out.withColumn("_r", F.row_number().over(order)).filter((F.col("kind") == "single") | (F.col("_r") <= max_pairs)).drop("_r")
    return out.drop("_newest", "position")


def ticker_candidates(df: DataFrame, earnings: DataFrame | None = None, *, symbol="symbol", d="d") -> tuple[DataFrame, dict[str, Column]]:
    """The candidate conditions of the ticker scan: calendar, after streaks and moves, extremes, volume, gaps, compression, position, earnings windows,
    combinations and engulfing. Everything is computed on the full series."""
    w = sessions(symbol, d)
    rows = engulfing(streak(volume_features(forward_closes(returns(df, symbol=symbol, d=d), 5, symbol=symbol, d=d), symbol=symbol, d=d), symbol=symbol, d=d), symbol=symbol, d=d)
    rows = rows.withColumns({
        "gap_pct": change_pct("open", F.col("prev_close")), "range_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 100.0,
        "ma20": rolling("mean", "close", w, 20), "hi52": rolling("max", "close", w, 252, 20), "lo52": rolling("min", "close", w, 252, 20),
        "max20": rolling("max", "var_pct", w, 20), "min20": rolling("min", "var_pct", w, 20)})
    rows = rows.withColumns({"atr5": rolling("mean", "range_pct", w, 5), "atr20": rolling("mean", "range_pct", w, 20)} |
                            {f"p_{c}": F.lag(c).over(w) for c in ("consec_up", "consec_dn", "var_pct", "max20", "min20")})
    marks = {}
    if earnings is not None:
        spans = {"near": (-5, 5), "pre": (-5, -1), "post": (1, 3), "day": (0, 1)}
        for name, (lo, hi) in spans.items():
            near = earnings.select(*keys(symbol), F.explode(F.sequence(F.date_add(d, lo), F.date_add(d, hi))).alias(d)).distinct().withColumn(f"_e_{name}", F.lit(True))
            rows = rows.join(near, [*keys(symbol), d], "left")
            marks[name] = truth(f"_e_{name}")
    col = F.col
    c: dict[str, Column] = {f"weekday {i}": col("dow") == i for i in range(5)}
    c |= {f"month {m}": col("month") == m for m in range(1, 13)} | {f"quarter {q}": F.quarter(d) == q for q in range(1, 5)}
    day = F.dayofmonth(d)
    c |= {"month start": day <= 10, "month middle": (day > 10) & (day <= 20), "month end": day > 20}
    for n in (2, 3, 4, 5):
        c |= {f"after {n} up": col("p_consec_up") >= n, f"after {n} down": col("p_consec_dn") >= n}
    for x in (3, 5, 7, 10):
        c |= {f"after fall {x}": col("p_var_pct") <= -x, f"after rise {x}": col("p_var_pct") >= x}
    c |= {"after 20d worst": col("p_var_pct") == col("p_min20"), "after 20d best": col("p_var_pct") == col("p_max20"), "volume > 1.5": col("vol_ratio") > 1.5,
          "volume > 2": col("vol_ratio") > 2.0, "volume < 0.5": col("vol_ratio") < 0.5, "volume rising": col("vol_up3") >= 3}
    for x in (2, 5):
        c |= {f"gap > {x}": col("gap_pct") > x, f"gap < -{x}": col("gap_pct") < -x}
    c |= {"atr compressed": col("atr5") < col("atr20") * 0.5, "range compressed": col("range_pct") < col("atr20") * 0.5, "below ma20": col("close") < col("ma20"),
          "above ma20": col("close") > col("ma20"), "near 52w low": change_pct("close", "lo52") < 5, "near 52w high": F.try_divide(col("hi52") - col("close"), col("hi52")) * 100.0 < 5}
    if marks:
        c |= {"before earnings": marks["pre"], "after earnings": marks["post"], "earnings gap > 10": marks["day"] & (col("gap_pct") > 10),
              "earnings gap < -10": marks["day"] & (col("gap_pct") < -10)}
    c |= {"volume > 1.5 and fall > 5": (col("vol_ratio") > 1.5) & (col("var_pct") < -5), "volume < 0.5 and rise > 3": (col("vol_ratio") < 0.5) & (col("var_pct") > 3),
          "volume > 2 and rise > 5": (col("vol_ratio") > 2.0) & (col("var_pct") > 5), "gap < -2 on monday": (col("gap_pct") < -2) & (col("dow") == 0),
          "gap > 2 on friday": (col("gap_pct") > 2) & (col("dow") == 4), "after 3 down, volume rising": (col("p_consec_dn") >= 3) & (col("vol_up3") >= 3)}
    far = ~marks["near"] if marks else F.lit(True)
    bear, bull = col("bearish_engulfing") & far, col("bullish_engulfing") & far
    low = F.least(*[col(f"{k}_j{h}") for k in ("close", "low") for h in range(1, 6)])
    high = F.greatest(*[col(f"close_j{h}") for h in range(1, 6)])
    c |= {"bearish engulfing": bear, "bearish engulfing validated": bear & (low <= col("close") * 0.98), "bullish engulfing": bull,
          "bullish engulfing validated": bull & (high >= col("close") * 1.02), "bearish engulfing, volume > 1.5": bear & (col("vol_ratio") > 1.5),
          "bullish engulfing, volume > 1.5": bull & (col("vol_ratio") > 1.5), "bearish engulfing after 3 up": bear & (col("p_consec_up") >= 3)}
    return rows, c


def ticker_pattern_scan(df: DataFrame, earnings: DataFrame | None = None, horizons=(1, 2, 3, 4, 5), min_is: int = 20, min_rate: float = 65.0, min_median: float = 2.0,
                        min_oos: int = 6, top: int | None = None, is_ratio: float = 0.7, *, symbol="symbol", d="d") -> DataFrame:
    """Every candidate at J+1..J+5 for every symbol at once: in sample (first 70 % of the rows) one direction at ``min_rate`` and a median of ``min_median``;
    the out-of-sample share is reported; ranked per symbol (``top``: only the best)."""
    rows, conditions = ticker_candidates(df, earnings, symbol=symbol, d=d)
    rows = rows.withColumns({"_rn": F.row_number().over(sessions(symbol, d)), "_n": F.count(F.lit(1)).over(whole(symbol))})
    rows = rows.withColumn("_is", F.col("_rn") <= F.floor(F.col("_n") * is_ratio))
    rows = spread_matches(rows, conditions, "candidate").select(*keys(symbol), "candidate", "_is", *[f"var_j{h}" for h in horizons])
    aggs, groups = [], {}
    for h in horizons:
        v, ins = F.col(f"var_j{h}"), F.col("_is") & F.col("var_j1").isNotNull()
        out_ = ~F.col("_is")
        aggs += [F.count(F.when(ins, v)).alias(f"n{h}"), count_where(ins & (v > 0)).alias(f"u{h}"), count_where(ins & (v < 0)).alias(f"d{h}"), median(F.when(ins, v)).alias(f"m{h}"),
                 mean_where(v, ins).alias(f"a{h}"), F.count(F.when(out_, v)).alias(f"on{h}"), count_where(out_ & (v > 0)).alias(f"ou{h}"), count_where(out_ & (v < 0)).alias(f"od{h}")]
        groups[h] = tuple(f"{p}{h}" for p in ("n", "u", "d", "m", "a", "on", "ou", "od"))
    out = unpivot(rows.groupBy(*keys(symbol), "candidate").agg(*aggs), [*keys(symbol), "candidate"], groups, ["horizon", "n", "_u", "_d", "median_amp", "mean_amp", "n_oos", "_ou", "_od"])
    up, down = ratio("_u", "n") * 100.0, ratio("_d", "n") * 100.0
    rises = (up >= min_rate) & (F.col("median_amp") >= min_median)
    falls = ~truth(rises) & (down >= min_rate) & (F.abs("median_amp") >= min_median)
    out = out.filter(F.col("n") >= min_is).withColumn("direction", F.when(rises, "up").when(falls, "down")).filter("direction IS NOT NULL")
    is_up = F.col("direction") == "up"
    oos = F.when(F.col("n_oos") >= min_oos, ratio(F.when(is_up, F.col("_ou")).otherwise(F.col("_od")), "n_oos") * 100.0)
    out = out.withColumns({"rate": F.when(is_up, up).otherwise(down), "oos_pct": oos})
    out = out.withColumn("oos_valid", truth(F.col("oos_pct") >= 50))
    order = Window.partitionBy(*keys(symbol)).orderBy(F.col("rate").desc(), "candidate", "horizon")
    out = out.withColumns({"actionable": (F.col("rate") >= 95) & F.col("oos_valid"), "rank": F.row_number().over(order)})
    return best_ranks(out, top).drop("_u", "_d", "_ou", "_od")


def candle_pattern_discovery(df: DataFrame, min_n: int = 3, *, symbol="symbol", d="d") -> DataFrame:
    """I4: fifteen colour and size candidates: next-day open-to-close mean, median and hit rate, edge over the baseline and a score."""
    w = sessions(symbol, d)
    r = change("close", "open")
    rows = df.withColumns({"_c": color(), "_r": r, "_span": F.try_divide(F.col("high") - F.col("low"), F.col("open"))})
    rows = rows.withColumns({"_n": F.lead("_r").over(w), "_c1": F.lag("_c").over(w), "_c2": F.lag("_c", 2).over(w)}).filter(F.col("_n").isNotNull())
    red, green = F.col("_c") == -1, F.col("_c") == 1
    red1, green1, red2, green2 = F.col("_c1") == -1, F.col("_c1") == 1, F.col("_c2") == -1, F.col("_c2") == 1
    size = F.abs("_r")
    cands = {"1_green": green, "1_red": red, "2_green": green & green1, "2_red": red & red1, "3_green": green & green1 & green2, "3_red": red & red1 & red2,
             "ret_gt_1pct": F.col("_r") > 0.01, "ret_lt_m1pct": F.col("_r") < -0.01, "ret_abs_gt_1pct": size > 0.01, "body_gt_1pct": size > 0.01,
             "range_gt_2pct": F.col("_span") > 0.02, "red_red_green": red2 & red1 & green, "green_green_red": green2 & green1 & red, "red_green": red1 & green, "green_red": green1 & red}
    hit = F.avg(F.when(F.col("_n") > 0, 1.0).otherwise(0.0))
    base = rows.groupBy(*keys(symbol)).agg(hit.alias("baseline_hit_rate"))
    out = spread_matches(rows, cands, "pattern").groupBy(*keys(symbol), "pattern").agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("mean_next"), median("_n").alias("median_next"), hit.alias("hit_rate"))
    out = out.filter(F.col("n") >= min_n).join(base, keys(symbol))
    edge = F.col("hit_rate") - F.col("baseline_hit_rate")
    return out.withColumns({"edge": edge, "score": F.abs("mean_next") * 10000.0 * F.log1p("n") + F.greatest(edge, F.lit(0.0)) * 100.0})


@F.pandas_udf(DoubleType())
def binomial_two_sided(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Exact two-sided binomial p-value of k rises in n trials at rate p, on aggregated rows."""
    top = int(n.max()) if len(n) else 0
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))]) if top else np.zeros(1)
    out = []
    for ki, ni, pi in zip(k, n, p):
        if ni is None or np.isnan(ni) or ni <= 0 or pi is None or np.isnan(pi):
            out.append(np.nan)
            continue
        ki, ni = int(ki), int(ni)
        if pi <= 0.0 or pi >= 1.0:
            out.append(1.0 if ki == (0 if pi <= 0.0 else ni) else 0.0)
            continue
        x = np.arange(ni + 1)
        logs = log_fact[ni] - log_fact[x] - log_fact[ni - x] + x * np.log(pi) + (ni - x) * np.log1p(-pi)
        probs = np.exp(logs)
        # outcomes no more likely than the observed one, with the customary relative slack
        out.append(min(1.0, float(probs[logs <= logs[ki] + 1e-7].sum())))
    return pd.Series(out)


TARGET_HORIZONS = ("ret_open_next", "ret_30min", "ret_60min", "ret_120min", "ret_close")


def threshold_direction_counts(series: DataFrame, targets: DataFrame, horizons=TARGET_HORIZONS, n_thresholds: int = 8, train: float = 0.7, min_points: int = 30, *, by="series",
                               d="d", value="value", target_by=()) -> DataFrame:
    """I5, the counting part: per (series, op, threshold, horizon) matches, rises and mean over all, training and last 30 % of the condition's dates, with
    the same figures for the opposite condition. Thresholds are eight percentiles from 10 to 90, rounded to two digits. ``targets`` has one row per day
    (of each ``target_by`` group, such as the symbol: then every condition is counted for every target)."""
    s = series.filter(F.col(value).isNotNull()).select(*keys(by), d, value)
    qs = [0.1 + 0.8 * i / (n_thresholds - 1) for i in range(n_thresholds)]
    levels = s.groupBy(*keys(by)).agg(F.count(F.lit(1)).alias("_n"), F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("_q")).filter(F.col("_n") >= min_points)
    levels = levels.select(*keys(by), F.array_distinct(F.transform("_q", lambda x: F.round(x, 2))).alias("_t"))
    rows = s.join(levels, keys(by)).select(*keys(by), d, value, F.explode("_t").alias("threshold"))
    rows = rows.select("*", F.explode(F.array(F.lit(">"), F.lit("<"))).alias("op"))
    hit = F.when(F.col("op") == ">", F.col(value) > F.col("threshold")).otherwise(F.col(value) < F.col("threshold"))
    w = Window.partitionBy(*keys(by), "threshold", "op")
    rows = rows.withColumn("_hit", hit)
    rows = rows.withColumns({"_rn": F.sum(F.col("_hit").cast("int")).over(w.orderBy(d).rowsBetween(Window.unboundedPreceding, 0)), "_k": F.sum(F.col("_hit").cast("int")).over(w)})
    late = F.col("_rn") > F.floor(F.col("_k") * train)
    rows = rows.withColumn("_late", late).join(targets.select(*target_by, d, *horizons), [d])
    aggs, groups = [], {}
    for i, h in enumerate(horizons):
        v, on = F.col(h), F.col("_hit")
        parts = {"": on, "train_": on & ~F.col("_late"), "oos_": on & F.col("_late"), "inv_": ~on}
        cols = []
        for p, c in parts.items():
            aggs += [F.count(F.when(c, v)).alias(f"{p}n{i}"), count_where(c & (v > 0)).alias(f"{p}b{i}"), mean_where(v, c).alias(f"{p}m{i}")]
            cols += [f"{p}n{i}", f"{p}b{i}", f"{p}m{i}"]
        groups[h] = tuple(cols)
    names = ["horizon"] + [f"{p}{x}" for p in ("", "train_", "oos_", "inv_") for x in ("n", "bull", "mean")]
    wide = rows.groupBy(*target_by, *keys(by), "op", "threshold").agg(*aggs)
    return unpivot(wide, [*target_by, *keys(by), "op", "threshold"], groups, names)


def threshold_direction_scan(series: DataFrame, targets: DataFrame, horizons=TARGET_HORIZONS, max_p: float = 0.05, min_n: int = 30, *, by="series", d="d", value="value",
                             base_target="ret_close", target_by=(), **kw) -> DataFrame:
    """Conditions whose share of rises differs from the base rate (exact two-sided binomial test) over all dates and again over the last 30 % of the
    condition's dates; marked when the opposite condition is significant in the other direction."""
    base = targets.groupBy(*target_by).agg(F.avg(F.when(F.col(base_target) > 0, 1.0).when(F.col(base_target).isNotNull(), 0.0)).alias("base_rate"))
    out = threshold_direction_counts(series, targets, horizons, by=by, d=d, value=value, target_by=target_by, **kw)
    out = out.join(base, list(target_by)) if target_by else out.withColumn("base_rate", base.scalar())
    out = out.filter((F.col("n") >= min_n) & (F.col("oos_n") >= min_n))
    out = out.withColumns({"p_value": binomial_two_sided("bull", "n", "base_rate"), "oos_p_value": binomial_two_sided("oos_bull", "oos_n", "base_rate"),
                           "inv_p_value": binomial_two_sided("inv_bull", "inv_n", "base_rate")})
    out = out.filter((F.col("p_value") < max_p) & (F.col("oos_p_value") < max_p))
    pct, inv = ratio("bull", "n") * 100.0, ratio("inv_bull", "inv_n") * 100.0
    out = out.withColumns({"pct_bull": pct, "oos_pct_bull": ratio("oos_bull", "oos_n") * 100.0, "inv_pct_bull": inv})
    return out.withColumn("invalidated", truth((F.col("inv_n") >= min_n) & (F.col("inv_p_value") < max_p) & ((F.col("pct_bull") > 50) != (F.col("inv_pct_bull") > 50))))


# Words of the macro buckets in the calendar text.
MACRO_WORDS = {"cpi": ["cpi", "inflation"], "fomc": ["fomc", "fed", "federal reserve"], "nfp": ["nfp", "nonfarm", "non farm"],
               "earnings": ["earnings", "resultats", "major companies"], "options_expiration": ["options expiration", "expiration", "opex"]}


def _summaries(v):
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.avg(F.when(v > 0, 1.0).when(v.isNotNull(), 0.0)).alias("positive_rate")]


def level_suffixes(rows: DataFrame, conditions: dict[str, Column], level="level", value="ret", *, symbol="symbol") -> DataFrame:
    """"Level >= x" for every level that occurs: rows are first summed per level, then accumulated from the highest level down, for each condition."""
    v = F.col(value)
    aggs = []
    for k, c in conditions.items():
        aggs += [count_where(truth(c) & v.isNotNull()).alias(f"n_{k}"), F.coalesce(F.sum(F.when(truth(c), v)), F.lit(0.0)).alias(f"s_{k}"), count_where(truth(c) & (v > 0)).alias(f"p_{k}")]
    per = rows.groupBy(*keys(symbol), level).agg(*aggs)
    down = Window.partitionBy(*keys(symbol)).orderBy(F.col(level).desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = {f"{x}_{k}": F.sum(f"{x}_{k}").over(down) for k in conditions for x in ("n", "s", "p")}
    per = per.withColumns({"_pos": F.row_number().over(Window.partitionBy(*keys(symbol)).orderBy(level)), "_cnt": F.count(F.lit(1)).over(whole(symbol))} | run)
    groups = {k: (f"n_{k}", f"s_{k}", f"p_{k}") for k in conditions}
    out = unpivot(per, [*keys(symbol), level, "_pos", "_cnt"], groups, ["condition", "n", "_s", "_p"])
    return out.withColumns({"mean": F.try_divide(F.col("_s"), F.col("n")), "positive_rate": F.try_divide(F.col("_p").cast("double"), F.col("n"))}).drop("_s", "_p")


def context_scan(df: DataFrame, levels: DataFrame, calendar: DataFrame | None = None, dollar: DataFrame | None = None, min_combo_n: int = 5, samples: int | None = None, edge: int = 10, *,
                 symbol="symbol", d="d") -> DataFrame:
    """Mean move by month, above every level of another series, on macro event days, by the dollar's direction, and combinations of all levels
    (``samples``: about so many, and the lowest and highest ``edge``) with a falling dollar or a CPI day; ranked per symbol."""
    ret = df.select(*keys(symbol), d, change("close", F.lag("close").over(sessions(symbol, d))).alias("ret")).filter("ret IS NOT NULL")
    v = F.col("ret")
    parts = [ret.groupBy(*keys(symbol), F.concat(F.lit("month:"), F.date_format(d, "yyyy-MM")).alias("bucket")).agg(*_summaries(v))]
    rows = ret.join(levels.select(d, F.col("close").alias("level")).filter("level IS NOT NULL"), [d])
    conds = {"alone": F.lit(True)}
    if dollar is not None:
        moves = dollar.select("symbol", d, (F.col("close") - F.lag("close").over(sessions("symbol", d))).alias("_dx")).select(d, "_dx")
        direction = F.when(F.col("_dx") > 0, "dollar:up").when(F.col("_dx") < 0, "dollar:down")
        parts.append(ret.join(moves, [d]).withColumn("bucket", direction).filter("bucket IS NOT NULL").groupBy(*keys(symbol), "bucket").agg(*_summaries(v)))
        rows = rows.join(moves, [d], "left")
        conds["dollar_down"] = F.col("_dx") < 0
    if calendar is not None:
        kinds = F.array_compact(F.array(*[F.when(contains_any("event", words), F.lit(f"macro:{k}")) for k, words in MACRO_WORDS.items()]))
        days = calendar.select(d, F.explode(kinds).alias("bucket")).distinct()
        parts.append(ret.join(days, [d]).groupBy(*keys(symbol), "bucket").agg(*_summaries(v)))
        cpi = calendar.filter(contains_any("event", ["cpi"])).select(d).distinct().withColumn("_cpi", F.lit(True))
        rows = rows.join(cpi, [d], "left")
        conds["cpi"] = F.col("_cpi")
    suffix = level_suffixes(rows, conds, symbol=symbol)
    label = F.concat(F.lit("level>="), F.round("level", 4).cast("string"))
    parts.append(suffix.filter("condition = 'alone'").select(*keys(symbol), label.alias("bucket"), "n", "mean", "positive_rate"))
    sampled = F.lit(True)
    if samples is not None:
        step = F.greatest(F.lit(1), F.floor(F.col("_cnt") / samples))
        sampled = ((F.col("_pos") - 1) % step == 0) | (F.col("_pos") <= edge) | (F.col("_pos") > F.col("_cnt") - edge)
    combo = suffix.filter(sampled & (F.col("n") >= min_combo_n))
    combo_label = F.concat(F.lit("combo:"), label, F.when(F.col("condition") == "alone", "").otherwise(F.concat(F.lit(" & "), F.col("condition"))))
    parts.append(combo.select(*keys(symbol), combo_label.alias("bucket"), "n", "mean", "positive_rate"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy(*keys(symbol)).orderBy(F.col("mean").desc(), F.col("positive_rate").desc(), F.col("n").desc(), "bucket")
    return out.filter(F.col("n") > 0).withColumn("rank", F.row_number().over(order))


def pair_outperformance(a: DataFrame, b: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """The spread of daily returns of each symbol of ``a`` over the series ``b``, overall (null month) and by calendar month."""
    def moves(df, cols, name):
        return df.select(*cols, d, change("close", F.lag("close").over(sessions("symbol", d))).alias(name))
    both = moves(a, keys(symbol), "_a").join(moves(b, [], "_b"), [d]).withColumn("_s", F.col("_a") - F.col("_b")).filter("_s IS NOT NULL")
    both = both.withColumn("month", F.month(d))
    sym = keys(symbol)
    return both.groupingSets([[*map(F.col, sym)], [*map(F.col, sym), F.col("month")]], *sym, "month").agg(*_summaries(F.col("_s")))


TARGETS = ("gap", "intraday", "next_close", "plus3d", "plus5d")


def target_moves(df: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """The moves a scan summarises: opening gap, open to close, close to the next, third and fifth close."""
    w = sessions(symbol, d)
    return df.withColumns({"gap": change("open", F.lag("close").over(w)), "intraday": change("close", "open"), "next_close": change(F.lead("close").over(w), "close"),
                           "plus3d": change(F.lead("close", 3).over(w), "close"), "plus5d": change(F.lead("close", 5).over(w), "close")})


def tree_column(tree, chosen: dict[str, Column]) -> Column:
    """A tree of ``("and", a, b)``, ``("or", a, b)``, ``("not", a)`` and driver names as a column."""
    if isinstance(tree, str):
        return chosen.get(tree, F.lit(True))
    head, *parts = tree
    cols = [tree_column(p, chosen) for p in parts]
    return ~cols[0] if head == "not" else (cols[0] & cols[1] if head == "and" else cols[0] | cols[1])


def logic_tree_scan(rows: DataFrame, drivers: dict[str, str], tree=None, labels=("low", "high"), max_assignments: int | None = None, min_n: int = 12, top: int | None = None, *, symbol="symbol") -> DataFrame:
    """Every assignment of bucket labels to the drivers through an AND/OR/NOT tree (all drivers joined by AND without one): sample, mean moves, and
    share of openings up and down. ``drivers`` maps a name to its bucket column; ``rows`` has the columns of ``target_moves``.

    Rows are summed once per combination of buckets; the assignments are evaluated on those few sums.
    """
    cols = list(drivers.values())
    for c in cols:
        rows = rows.filter(F.col(c).isNotNull())
    aggs = [F.count(F.lit(1)).alias("_n"), count_where(F.col("gap") > 0).alias("_up"), count_where(F.col("gap") < 0).alias("_down")]
    for t in TARGETS:
        aggs += [F.count(t).alias(f"_n_{t}"), F.sum(t).alias(f"_s_{t}")]
    sums = rows.groupBy(*keys(symbol), *cols).agg(*aggs)
    names = list(drivers)
    options = list(itertools.product(labels, repeat=len(names)))[:max_assignments]
    rows_ = [F.struct(F.lit(" | ".join(f"{n}={v}" for n, v in zip(names, o))).alias("assignment"), *[F.lit(v).alias(f"_v{i}") for i, v in enumerate(o)]) for o in options]
    spread = sums.select("*", F.inline(F.array(*rows_)))
    chosen = {n: F.col(c) == F.col(f"_v{i}") for i, (n, c) in enumerate(drivers.items())}
    spread = spread.filter(tree_column(tree, chosen) if tree is not None else all_of(list(chosen.values())))
    out = spread.groupBy(*keys(symbol), "assignment").agg(
        F.sum("_n").alias("n"), F.try_divide(F.sum("_up").cast("double"), F.sum("_n_gap")).alias("open_up_prob"), F.try_divide(F.sum("_down").cast("double"), F.sum("_n_gap")).alias("open_down_prob"),
        *[F.try_divide(F.sum(f"_s_{t}"), F.sum(f"_n_{t}")).alias(f"{t}_mean") for t in TARGETS])
    order = Window.partitionBy(*keys(symbol)).orderBy(F.col("n").desc(), F.abs(F.coalesce("plus5d_mean", F.lit(0.0))).desc(), F.abs(F.coalesce("next_close_mean", F.lit(0.0))).desc(), "assignment")
    return best_ranks(out.filter(F.col("n") >= min_n).withColumn("rank", F.row_number().over(order)), top)


def score_scan_rows(rows: DataFrame) -> DataFrame:
    """Sample, magnitude and probability scores of scan rows, their weighted confidence with label and flags, and a priority."""
    means = [F.col(f"{t}_mean") for t in TARGETS]
    known = F.array_compact(F.array(*means))
    size = F.size(known)
    magnitude = F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + F.abs(x)), size), F.lit(0.0))
    direction = F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), size), F.lit(0.0))
    n = F.col("n")
    sample = F.when(n >= 300, 1.0).when(n >= 150, 0.8).when(n >= 80, 0.6).when(n >= 40, 0.4).when(n >= 20, 0.25).when(n.isNotNull(), 0.1).otherwise(0.0)
    up, down = F.col("open_up_prob"), F.col("open_down_prob")
    best = F.when(down.isNull() | (up >= down), up).otherwise(down)
    out = rows.withColumns({"sample_score": sample, "_mag": magnitude, "direction_score": direction, "probability_score": F.coalesce(F.abs(best - 0.5) * 2.0, F.lit(0.0)),
                            "magnitude_score": F.least(F.lit(1.0), magnitude / 0.02)})
    total = F.col("sample_score") * 0.5 + F.col("magnitude_score") * 0.3 + F.col("probability_score") * 0.2
    out = out.withColumn("confidence_score", total)
    flags = F.array_compact(F.array(F.when(n.isNull() | (n < 40), "small sample"), F.when(F.col("probability_score") < 0.1, "weak direction"),
                                    F.when(F.col("magnitude_score") < 0.15, "small effect"), F.when(F.col("direction_score") == 0, "unclear")))
    return out.withColumns({
        "confidence_label": F.when(total >= 0.75, "strong").when(total >= 0.5, "medium").otherwise("weak"), "flags": flags,
        "direction_label": F.when(F.col("direction_score") > 0, "up").when(F.col("direction_score") < 0, "down").otherwise("neutral"),
        "priority": F.col("confidence_score") * 0.6 + F.col("magnitude_score") * 0.4}).drop("_mag")


def rare_edge_scan(df: DataFrame, features, target, min_n: int = 20, top: int | None = None, *, symbol="symbol") -> DataFrame:
    """Per feature and value: frequency, mean return, and rarity times its size; ranked per symbol (``top``: only the best)."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    total = df.groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("_n"))
    out = df.select(*keys(symbol), F.col(target).alias("_t"), F.inline(rows)).filter("value IS NOT NULL").groupBy(*keys(symbol), "feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_t").alias("mean_return"))
    out = out.filter(F.col("n") >= min_n).join(total, keys(symbol)).withColumn("freq", ratio("n", "_n")).drop("_n")
    out = out.withColumn("edge_score", (F.lit(1.0) - F.col("freq")) * F.abs("mean_return"))
    order = Window.partitionBy(*keys(symbol)).orderBy(F.col("edge_score").desc(), "feature", "value")
    return best_ranks(out.withColumn("rank", F.row_number().over(order)), top)
