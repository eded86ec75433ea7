"""Aggregations and event-study summaries.

Inputs are bar tables with the columns of ``series.returns`` where a next move is needed; leads and lags are
taken before any filter. Results are grouped by symbol, so one call serves every symbol of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    as_col, change_pct, compare, count_where, mean_where, median, pearson, ratio, sample_skewness, truth,
)
from ..functions.windows import keys, rolling_correlation, sessions, so_far, whole
from .candles import unpivot
from .filters import boolean_expr
from .joins import spread_nearest
from .series import returns


def positive_pct(value) -> Column:
    """Share of positive values in percent among all rows that have one."""
    value = as_col(value)
    return F.avg(F.when(value > 0, 1.0).when(value.isNotNull(), 0.0)) * 100.0


def quantiles(value, qs) -> Column:
    return F.percentile(as_col(value), F.array(*[F.lit(q) for q in qs]))


def event_stats(df: DataFrame, cond=None, return_type: str = "close_to_close", *, symbol="symbol", d="d") -> DataFrame:
    """statistics of the move on the days where a condition holds: close to close (falls are "not up") or
    open to close. Best and worst days take the earliest date on ties."""
    rows = returns(df, symbol=symbol, d=d)
    if return_type == "close_to_close":
        v, pts = F.col("var_pct"), F.col("close") - F.col("prev_close")
    else:
        v, pts = change_pct("close", "open"), F.col("close") - F.col("open")
    rows = rows.withColumns({"_v": v, "_p": pts})
    rows = rows.filter(truth(cond) & F.col("_v").isNotNull()) if cond is not None else rows.filter(F.col("_v").isNotNull())
    day = F.datediff(d, F.lit("1970-01-01").cast("date"))
    bear = F.lit(100.0) - positive_pct("_v") if return_type == "close_to_close" else F.avg(F.when(F.col("_v") < 0, 1.0).otherwise(0.0)) * 100.0
    return rows.groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean_var"), F.avg("_p").alias("mean_pts"), positive_pct("_v").alias("pct_bull"),
        bear.alias("pct_bear"), F.max_by(d, F.struct(F.col("_v"), -day)).alias("best_d"), F.max("_v").alias("best"),
        F.min_by(d, F.struct(F.col("_v"), day)).alias("worst_d"), F.min("_v").alias("worst"))


def conditional_next(df: DataFrame, cond, *, symbol="symbol") -> DataFrame:
    """what followed the days of a condition: days, share of rises, mean and median of the next move."""
    nv = F.col("next_var")
    return df.filter(truth(cond)).groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), positive_pct(nv).alias("pct_pos_next"), F.avg(nv).alias("mean_next"), median(nv).alias("median_next"))


def move_condition(value, threshold: float, direction: str) -> Column:
    value = as_col(value)
    return {"down": value <= -threshold, "up": value >= threshold}.get(direction, F.abs(value) >= threshold)


def multi_threshold_next(df: DataFrame, thresholds, direction: str = "down", *, symbol="symbol") -> DataFrame:
    """per threshold the days beyond it, their share, and the next move; the threshold with the best
    share of rises is marked (the first on ties). All thresholds come from one aggregation."""
    nv = F.col("next_var")
    aggs, groups = [F.count(F.lit(1)).alias("total")], {}
    for i, t in enumerate(thresholds):
        hit = truth(move_condition("var_pct", t, direction))
        aggs += [count_where(hit).alias(f"n{i}"), (mean_where(F.when(nv > 0, 1.0).when(nv.isNotNull(), 0.0), hit) * 100.0).alias(f"p{i}"),
                 mean_where(nv, hit).alias(f"m{i}")]
        groups[float(t)] = (f"n{i}", f"p{i}", f"m{i}")
    out = unpivot(df.groupBy(*keys(symbol)).agg(*aggs), [*keys(symbol), "total"], groups, ["threshold", "n", "pct_pos_next", "mean_next"])
    best = F.max(F.when(F.col("pct_pos_next") > 0, F.struct(F.col("pct_pos_next"), -F.col("threshold")))).over(whole(symbol))
    return out.withColumns({"pct_of_total": ratio("n", "total") * 100.0,
                            "is_best": truth(F.struct(F.col("pct_pos_next"), -F.col("threshold")) == best)})


def threshold_next_direction(df: DataFrame, thresholds, is_drop: bool = True, next_positive: bool = True, dates: DataFrame | None = None, *,
                             symbol="symbol", d="d") -> DataFrame:
    """F3, two-sided: share of days beyond each threshold followed by a rise (or a fall), optionally on given
    dates only. Days without a previous or next close do not count."""
    rows = df.filter(F.col("prev_close").isNotNull() & F.col("next_close").isNotNull())
    if dates is not None:
        rows = rows.join(dates, [d], "left_semi")
    follow = F.col("next_close") > F.col("close") if next_positive else F.col("next_close") < F.col("close")
    aggs, groups = [], {}
    for i, t in enumerate(thresholds):
        hit = F.col("var_pct") <= -t if is_drop else F.col("var_pct") >= t
        aggs += [count_where(hit).alias(f"n{i}"), count_where(hit & follow).alias(f"h{i}")]
        groups[float(t)] = (f"n{i}", f"h{i}")
    out = unpivot(rows.groupBy(*keys(symbol)).agg(*aggs), keys(symbol), groups, ["threshold", "n", "hits"])
    return out.withColumn("pct_next", F.coalesce(ratio("hits", "n") * 100.0, F.lit(0.0)))


def filter_moves(df: DataFrame, criterion: str = "abs", threshold: float = 5.0) -> DataFrame:
    """days of a drop, gain or absolute move; an ``intraday_`` prefix takes open to close. Adds ``move``."""
    intraday = criterion.startswith("intraday")
    move = change_pct("close", "open") if intraday else F.col("var_pct")
    kind = {"drop": "down", "gain": "up"}.get(criterion.replace("intraday_", ""), "abs")
    return df.withColumn("move", move).filter(move_condition("move", threshold, kind))


def grouped_moves(df: DataFrame, by, names=("n", "mean_var", "median_var", "pct_positive")) -> DataFrame:
    v = F.col("var_pct")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(names[0]), F.avg(v).alias(names[1]), median(v).alias(names[2]),
                               (ratio(count_where(v > 0), F.count(F.lit(1))) * 100.0).alias(names[3]))


def weekday_stats(df: DataFrame, *, symbol="symbol") -> DataFrame:
    """moves by weekday, Monday to Friday, ranked by mean."""
    out = grouped_moves(df.filter(F.col("dow") < 5), [*keys(symbol), "dow"])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys(symbol)).orderBy(F.col("mean_var").desc(), "dow")))


def month_stats(df: DataFrame, *, symbol="symbol") -> DataFrame:
    """moves by calendar month, ranked by mean."""
    out = grouped_moves(df, [*keys(symbol), "month"])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys(symbol)).orderBy(F.col("mean_var").desc(), "month")))


def period_perf(df: DataFrame, unit: str = "year", base: str = "first_open", *, symbol="symbol", d="d") -> DataFrame:
    """percentage from the first open (or first close) to the last close of each year or month."""
    rows = df.filter(F.col("open").isNotNull() & F.col("close").isNotNull()) if base == "first_open" else df.filter(F.col("close").isNotNull())
    period = F.trunc(d, unit).alias("period")
    price = "open" if base == "first_open" else "close"
    out = rows.groupBy(*keys(symbol), period).agg(F.min_by(price, d).alias("base"), F.max_by("close", d).alias("last_close"))
    return out.withColumn("perf_pct", change_pct("last_close", "base"))


def compare_means(df: DataFrame, a, b, value, *, symbol="symbol") -> DataFrame:
    """F8: one metric for two slots (conditions) side by side; the leader has the larger mean, the first on ties."""
    out = df.groupBy(*keys(symbol)).agg(count_where(a).alias("n_a"), count_where(b).alias("n_b"), mean_where(value, truth(a)).alias("mean_a"),
                                        mean_where(value, truth(b)).alias("mean_b"))
    return out.withColumns({"diff": F.abs(F.col("mean_a") - F.col("mean_b")),
                            "leader": F.when(F.col("mean_a") >= F.col("mean_b"), "a").otherwise("b")})


def compare_series(a: DataFrame, b: DataFrame, value: str, *, symbol="symbol", d="d") -> DataFrame:
    """F8: mean of a metric of each symbol of ``a`` and of the series ``b`` on their common days."""
    both = a.select(*keys(symbol), d, F.col(value).alias("_a")).join(b.select(d, F.col(value).alias("_b")), [d])
    out = both.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"))
    return out.withColumns({"diff": F.abs(F.col("mean_a") - F.col("mean_b")),
                            "leader": F.when(F.col("mean_a") >= F.col("mean_b"), "a").otherwise("b")})


def count_days(df: DataFrame, cond, *, symbol="symbol", d="d") -> DataFrame:
    """days on which a condition holds, all days, and the share."""
    hit = truth(cond)
    out = df.groupBy(*keys(symbol)).agg(count_where(hit).alias("n"), F.count(F.lit(1)).alias("total"),
                                        F.count_distinct(F.when(hit, F.col(d))).alias("n_days"))
    return out.withColumn("pct", F.coalesce(ratio("n", "total") * 100.0, F.lit(0.0)))


def extreme_days(df: DataFrame, direction: str = "down", by_year: bool = True, *, symbol="symbol", d="d") -> DataFrame:
    """the worst (``down``) or best day per year or overall; the earliest on ties."""
    rows = df.filter(F.col("var_pct").isNotNull())
    day = F.datediff(d, F.lit("1970-01-01").cast("date"))
    row = F.struct(d, "var_pct", "close")
    pick = F.min_by(row, F.struct(F.col("var_pct"), day)) if direction == "down" else F.max_by(row, F.struct(F.col("var_pct"), -day))
    by = [*map(F.col, keys(symbol)), *([F.year(d).alias("year")] if by_year else [])]
    names = [*keys(symbol), *(["year"] if by_year else [])]
    return rows.groupBy(*by).agg(pick.alias("_r")).select(*names, "_r.*")


def lookup(df: DataFrame, day, symbols=None, context: DataFrame | None = None, *, symbol="symbol", d="d") -> DataFrame:
    """the bar of a date with change and volume ratio, and the level of a context series that day."""
    rows = df.filter(F.col(d) == F.lit(day).cast("date"))
    if symbols:
        rows = rows.filter(F.col(symbol).isin(list(symbols)))
    if context is not None:
        rows = rows.join(context.select(d, F.col("close").alias("context_close")), [d], "left")
    return rows


def streak_table(df: DataFrame, direction: str = "up", *, symbol="symbol", d="d") -> DataFrame:
    """every run of rises (or falls): start, last day in the run, the day after it (``end_ref``; the last day for a run
    still open), length, rank by length (the earliest on ties) and the mean length."""
    w = sessions(symbol, d)
    cond = F.col("var_pct") > 0 if direction == "up" else F.col("var_pct") < 0
    rows = df.select(*keys(symbol), d, truth(cond).alias("_hit"), F.lead(d).over(w).alias("_next"), F.row_number().over(w).alias("_n"))
    # rows of one run share the number of non-matching rows seen before them
    rows = rows.withColumn("_run", F.col("_n") - F.sum(F.col("_hit").cast("int")).over(so_far(w)))
    runs = rows.filter("_hit").groupBy(*keys(symbol), "_run").agg(
        F.min(d).alias("start_d"), F.max(d).alias("last_in_run"), F.coalesce(F.max_by("_next", d), F.max(d)).alias("end_ref"), F.count(F.lit(1)).alias("length"))
    order = Window.partitionBy(*keys(symbol)).orderBy(F.col("length").desc(), "start_d")
    return runs.withColumns({"rank": F.row_number().over(order), "mean_length": F.avg("length").over(whole(symbol))}).drop("_run")


def bias(df: DataFrame, index: DataFrame | None = None, *, symbol="symbol") -> DataFrame:
    """up and down days, mean, median, corrected skewness, a label at 52/48 %, and the index beside it."""
    v = F.col("var_pct")
    out = df.groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("n"), count_where(v > 0).alias("n_pos"), F.avg(v).alias("mean_var"),
                                        median(v).alias("median_var"), sample_skewness(v).alias("skew"))
    pct = ratio("n_pos", "n") * 100.0
    out = out.withColumns({"n_neg": F.col("n") - F.col("n_pos"), "pct_pos": pct})
    out = out.withColumn("bias", F.when(F.col("pct_pos") > 52, "up").when(F.col("pct_pos") < 48, "down").otherwise("neutral"))
    if index is not None:
        one = index.agg((F.avg(F.when(v > 0, 1.0).otherwise(0.0)) * 100.0).alias("p"), F.avg(v).alias("m"))
        out = out.withColumns({"index_pct_pos": one.select("p").scalar(), "index_mean_var": one.select("m").scalar()})
    return out


def correlation(a: DataFrame, b: DataFrame, min_n: int = 20, value="var_pct", *, symbol="symbol", d="d") -> DataFrame:
    """Pearson correlation of the moves of each symbol of ``a`` with the series ``b`` on common days."""
    both = a.select(*keys(symbol), d, F.col(value).alias("_a")).join(b.select(d, F.col(value).alias("_b")), [d])
    both = both.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("n"), pearson("_a", "_b").alias("corr")).filter(F.col("n") >= min_n)


def correlation_scan(df: DataFrame, market: DataFrame, min_n: int = 30, min_abs: float = 0.05, top: int | None = None, tolerance_days: int = 2, *,
                     symbol="symbol", series="series", d="d") -> DataFrame:
    """correlation of each symbol's move with the level of every market series (nearest value within two
    days), strongest first."""
    near = spread_nearest(market, tolerance_days, by=series, d=d)
    rows = df.filter(F.col("var_pct").isNotNull()).select(*keys(symbol), d, "var_pct").join(near, [d])
    out = rows.groupBy(*keys(symbol), series).agg(F.count(F.lit(1)).alias("n"), pearson("var_pct", "value").alias("corr"))
    size = F.abs("corr")
    out = out.filter((F.col("n") >= min_n) & (size > min_abs)).withColumns({
        "strength": F.when(size > 0.6, "strong").when(size > 0.3, "moderate").otherwise("weak"),
        "rank": F.row_number().over(Window.partitionBy(*keys(symbol)).orderBy(size.desc(), series))})
    return out if top is None else out.filter(F.col("rank") <= top)


def correlation_catalog(long: DataFrame, months: int = 7, min_n: int = 20, families: DataFrame | None = None, *, by="series", d="d",
                        value="value") -> DataFrame:
    """F16: correlation of every pair of series over the last months of their common days.

    A series is packed into one row per month with a bit per day. Pairs first meet on these bits alone, which gives each
    pair's newest common day; only the last months of a pair are then joined with their values and unpacked.
    """
    s = long.filter(F.col(value).isNotNull())
    day = F.dayofmonth(d)
    packed = s.groupBy(F.col(by).alias("_k"), F.trunc(d, "month").alias("_m")).agg(
        F.map_from_entries(F.collect_list(F.struct(day.alias("day"), F.col(value).alias("v")))).alias("_days"),
        F.bit_or(F.pow(F.lit(2), day).cast("bigint")).alias("_bits"))
    if families is not None:
        packed = packed.join(families.select(F.col(by).alias("_k"), "family"), "_k", "left")
    else:
        packed = packed.withColumn("family", F.lit(None).cast("string"))
    a = packed.select("_m", F.col("_k").alias("a"), F.col("_bits").alias("_ba"), F.col("family").alias("_fa"))
    b = packed.select("_m", F.col("_k").alias("b"), F.col("_bits").alias("_bb"), F.col("family").alias("_fb"))
    met = a.join(b, "_m").filter((F.col("a") < F.col("b")) & ~truth(F.col("_fa") == F.col("_fb")))
    met = met.select("a", "b", "_m", F.col("_ba").bitwiseAND(F.col("_bb")).alias("_both")).filter("_both <> 0")
    newest = F.date_add("_m", F.floor(F.log2("_both")).cast("int") - 1)
    met = met.withColumn("_newest", F.max(newest).over(Window.partitionBy("a", "b")))
    met = met.filter(F.col("_m") >= F.trunc(F.add_months("_newest", -months), "month")).select("a", "b", "_m", "_newest")
    values = packed.select("_m", "_k", "_days")
    pairs = (met.join(values.select("_m", F.col("_k").alias("a"), F.col("_days").alias("_da")), ["a", "_m"])
             .join(values.select("_m", F.col("_k").alias("b"), F.col("_days").alias("_db")), ["b", "_m"]))
    shared = F.array_intersect(F.map_keys("_da"), F.map_keys("_db"))
    common = F.transform(shared, lambda k: F.struct(F.date_add("_m", k - 1).alias("d"), F.col("_da")[k].alias("x"), F.col("_db")[k].alias("y")))
    rows = pairs.select("a", "b", "_newest", F.inline(common)).filter(F.col("d") >= F.add_months("_newest", -months))
    out = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("corr"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    return out.filter(F.col("n") >= min_n).withColumn("abs_corr", F.abs("corr"))


def rolling_corr_rank(a: DataFrame, b: DataFrame, months: int = 7, window: int = 20, top: int | None = None, value="var_pct", *,
                      symbol="symbol", d="d") -> DataFrame:
    """days ranked by the rolling correlation of two series over the last months of their common days."""
    both = a.select(*keys(symbol), d, F.col(value).alias("_a")).join(b.select(d, F.col(value).alias("_b")), [d])
    both = both.withColumn("_newest", F.max(d).over(whole(symbol))).filter(F.col(d) >= F.add_months("_newest", -months))
    both = both.withColumn("corr", rolling_correlation("_a", "_b", sessions(symbol, d), window)).filter(F.col("corr").isNotNull())
    out = both.withColumn("rank", F.row_number().over(Window.partitionBy(*keys(symbol)).orderBy(F.col("corr").desc(), d)))
    out = out.select(*keys(symbol), d, "corr", "rank")
    return out if top is None else out.filter(F.col("rank") <= top)


def relation(a: DataFrame, b: DataFrame, *, symbol="symbol", d="d") -> DataFrame:
    """how two series relate on their common days: correlation of moves and of levels, share a above b,
    ratio and spread figures, and the days of the extreme ratios and spreads."""
    cols = lambda df, s: df.select(*(keys(symbol) if s == "a" else []), d, F.col("close").alias(f"_{s}"), F.col("var_pct").alias(f"_r{s}"))
    both = cols(a, "a").join(cols(b, "b"), [d])
    both = both.withColumns({"_ratio": F.try_divide(F.col("_a"), F.col("_b")), "_spread": F.col("_a") - F.col("_b")})
    day = F.datediff(d, F.lit("1970-01-01").cast("date"))
    q = quantiles("_ratio", (0.25, 0.5, 0.75))
    out = both.groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), pearson("_ra", "_rb").alias("ret_corr"), pearson("_a", "_b").alias("level_corr"),
        (F.avg(F.when(F.col("_a") > F.col("_b"), 1.0).otherwise(0.0)) * 100.0).alias("share_a_above_pct"), F.avg("_ratio").alias("ratio_mean"),
        q.alias("_q"), F.avg("_spread").alias("spread_mean"),
        F.max_by(d, F.struct(F.col("_ratio"), -day)).alias("max_ratio_d"), F.min_by(d, F.struct(F.col("_ratio"), day)).alias("min_ratio_d"),
        F.max_by(d, F.struct(F.col("_spread"), -day)).alias("max_spread_d"), F.min_by(d, F.struct(F.col("_spread"), day)).alias("min_spread_d"))
    return out.withColumns({f"ratio_p{p}": F.col("_q")[i] for i, p in enumerate((25, 50, 75))}).drop("_q")


def return_distribution(df: DataFrame, *, symbol="symbol") -> DataFrame:
    """one-percent bins of the move with their count, most frequent month and weekday (smallest on ties)."""
    rows = df.filter(F.col("var_pct").isNotNull()).withColumn("bin_low", F.floor("var_pct"))
    return rows.groupBy(*keys(symbol), "bin_low").agg(F.count(F.lit(1)).alias("n"), F.mode("month", True).alias("modal_month"), F.mode("dow", True).alias("modal_dow"))


def iso_week_rank(df: DataFrame, value="value", *, by="series", d="d") -> DataFrame:
    """mean, minimum and maximum per ISO week, ranked by mean, then maximum."""
    out = df.groupBy(*keys(by), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), F.weekofyear(d).alias("iso_week")).agg(
        F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys(by)).orderBy(F.col("mean_value").desc(), F.col("max_value").desc(), "iso_year", "iso_week")
    return out.withColumn("rank", F.row_number().over(order))


def lowest_weekday_by_year(df: DataFrame, value="value", *, by="series", d="d") -> DataFrame:
    """per year the weekday with the lowest mean."""
    means = df.groupBy(*keys(by), F.year(d).alias("year"), F.weekday(d).alias("weekday")).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    pick = F.min_by(F.struct("weekday", "mean_value", "n"), F.struct("mean_value", "weekday"))
    return means.groupBy(*keys(by), "year").agg(pick.alias("_r")).select(*keys(by), "year", "_r.*")


def month_hit_frequency(df: DataFrame, cond, k: int = 4, *, symbol="symbol", d="d") -> DataFrame:
    """months with at least k hit days; the latest of them is marked."""
    out = df.groupBy(*keys(symbol), F.trunc(d, "month").alias("month_start")).agg(count_where(cond).alias("n_hits")).filter(F.col("n_hits") >= k)
    return out.withColumn("is_latest", F.col("month_start") == F.max("month_start").over(whole(symbol)))


def threshold_occurrence(df: DataFrame, value, op: str, level: float, *, symbol="symbol", d="d") -> DataFrame:
    """first and last day meeting a threshold with its value, and the number of such days."""
    hits = df.filter(compare(value, op, level))
    return hits.groupBy(*keys(symbol)).agg(F.min(d).alias("first_d"), F.min_by(value, d).alias("first_value"), F.max(d).alias("last_d"),
                                           F.max_by(value, d).alias("last_value"), F.count(F.lit(1)).alias("n"))


def summarize(df: DataFrame, value, cond=None, *, symbol="symbol") -> DataFrame:
    """count, mean, median, minimum, maximum and deviation of a metric after conditions."""
    rows = df if cond is None else df.filter(truth(cond))
    v = as_col(value)
    return rows.groupBy(*keys(symbol)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"),
                                           F.stddev_samp(v).alias("std"))


def forward_summary(df: DataFrame, cond, value="fwd_return", rule: str = ">0", *, symbol="symbol") -> DataFrame:
    """forward returns on the days of a condition (the return is shifted on the full series first)."""
    v = as_col(value)
    direction = v > 0 if rule == ">0" else v < 0
    out = df.filter(truth(cond) & v.isNotNull()).groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("positive_rate"), F.max(v).alias("best"),
        F.min(v).alias("worst"), count_where(direction).alias("n_directional"))
    return out.withColumn("ratio_directional", ratio("n_directional", "n"))


def cross_asset_condition_mean(target: DataFrame, date_sets, value, *, symbol="symbol", d="d") -> DataFrame:
    """the target's mean, rises and days on dates where every other asset meets its condition."""
    rows = target
    for dates in date_sets:
        rows = rows.join(dates, [d], "left_semi")
    v = as_col(value)
    return rows.groupBy(*keys(symbol)).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), count_where(v > 0).alias("n_up"))


def composite_conditions(df: DataFrame, conds, value, weekday: int | None = None, years=None, per_year: bool = False, *, symbol="symbol",
                         d="d") -> DataFrame:
    """the AND of daily condition columns, with weekday and years; count and mean, per year if asked."""
    rows = df
    for c in conds:
        rows = rows.filter(truth(c))
    if weekday is not None:
        rows = rows.filter(F.weekday(d) == weekday)
    if years:
        rows = rows.filter(F.year(d).isin(list(years)))
    by = [*map(F.col, keys(symbol)), *([F.year(d).alias("year")] if per_year else [])]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def boolean_condition_metric(df: DataFrame, tree, value, *, symbol="symbol") -> DataFrame:
    """count, probability of a positive value, and mean, on the rows of a condition tree."""
    v = as_col(value)
    return df.filter(boolean_expr(tree)).groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("probability"), F.avg(v).alias("mean"))


def neutral_next(df: DataFrame, threshold: float = 5.0, top: int | None = None, *, symbol="symbol", d="d") -> DataFrame:
    """after a fall of at least the threshold, all days ranked by how near the next move was to zero (``top``: only the first)."""
    rows = df.filter((F.col("var_pct") <= -threshold) & F.col("next_var").isNotNull()).withColumn("abs_next", F.abs("next_var"))
    w = Window.partitionBy(*keys(symbol)).orderBy("abs_next", d)
    rows = rows.withColumns({"rank": F.row_number().over(w), "n_total": F.count(F.lit(1)).over(whole(symbol))})
    return rows if top is None else rows.filter(F.col("rank") <= top)


def open_up_count(df: DataFrame, other: DataFrame, threshold: float, *, symbol="symbol", d="d") -> DataFrame:
    """sessions opening above the previous close while another series is above a level. The previous close is that of
    the previous common day."""
    both = df.filter(F.col("open").isNotNull() & F.col("close").isNotNull()).join(
        other.filter(F.col("close").isNotNull()).select(d, F.col("close").alias("_o")), [d])
    both = both.withColumn("_up", truth(F.col("open") > F.lag("close").over(sessions(symbol, d))))
    out = both.filter(F.col("_o") > threshold).groupBy(*keys(symbol)).agg(count_where("_up").alias("n_up"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("pct", ratio("n_up", "total") * 100.0)


def amplitude_distribution(df: DataFrame, levels: DataFrame, level_min: float | None = None, level_max: float | None = None,
                           thresholds=(10, 15, 20, 25, 30, 35, 40, 50, 60), *, symbol="symbol", d="d") -> DataFrame:
    """high-low and open-close amplitude in points on sessions whose last known level (open of another series)
    lies in a range; the share at or above each threshold."""
    from .joins import asof_join
    rows = asof_join(df, levels.select(d, F.col("open").alias("_level")), on=d)
    if level_min is not None:
        rows = rows.filter(F.col("_level") >= level_min)
    if level_max is not None:
        rows = rows.filter(F.col("_level") <= level_max)
    hl, co = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    aggs = [F.count(F.lit(1)).alias("n_sessions"), median(hl).alias("hl_median"), F.avg(hl).alias("hl_mean"), median(co).alias("co_median")]
    groups = {}
    for i, t in enumerate(thresholds):
        aggs += [(F.avg(F.when(hl >= t, 1.0).when(hl.isNotNull(), 0.0)) * 100.0).alias(f"h{i}"),
                 (F.avg(F.when(co >= t, 1.0).when(co.isNotNull(), 0.0)) * 100.0).alias(f"c{i}")]
        groups[float(t)] = (f"h{i}", f"c{i}")
    wide = rows.groupBy(*keys(symbol)).agg(*aggs)
    return unpivot(wide, [*keys(symbol), "n_sessions", "hl_median", "hl_mean", "co_median"], groups, ["threshold", "pct_hl_above", "pct_co_above"])
