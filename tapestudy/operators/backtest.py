"""Backtests, universe jobs and option structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, change, change_pct, count_where, mean_where, median, truth
from ..functions.windows import keys, sessions
from .joins import asof_join, enrich_with_dimension, event_to_session, nearest_strike


def signal_backtest(df: DataFrame, cond, *, symbol="symbol", d="d") -> DataFrame:
    """The next session's open-to-close return after a condition: trades, mean, median, hit rate and compounded return."""
    w = sessions(symbol, d)
    rows = df.withColumns({"_hit": truth(cond), "_r": change(F.lead("close").over(w), F.lead("open").over(w))})
    r = F.col("_r")
    return rows.filter(F.col("_hit") & r.isNotNull()).groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_ret"), median(r).alias("median_ret"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        (F.product(r + 1.0) - 1.0).alias("compounded"))


def drift_measures(bars: DataFrame, events: DataFrame, live: bool = False, *, symbol="symbol", d="d") -> DataFrame:
    """J2, the part that no parameter changes: per event the reaction session J, the size of the five prior ranges against the mean range of the twenty prior
    sessions, the move on J, and the trade from the open of J+1 to the close of J+5. Events without J-20..J+5 are dropped;
    with ``live`` J is enough, and entry and exit are null as far as they are not known yet.

    All bar columns come from one window pass per symbol; events meet them by equality on (symbol, session).
    """
    w = sessions(symbol, d)
    span = F.col("high") - F.col("low")
    rows = bars.withColumns({"_span": span, "_i": F.row_number().over(w)})
    mean20 = F.avg("_span").over(w.rowsBetween(-20, -1))
    last5 = F.collect_list("_span").over(w.rowsBetween(-5, -1))
    rows = rows.withColumns({"_mean20": mean20, "_last5": last5, "_c1": F.lag("close").over(w), "entry_d": F.lead(d).over(w), "entry_open": F.lead("open").over(w),
                             "exit_d": F.lead(d, 5).over(w), "exit_close": F.lead("close", 5).over(w)})
    rows = rows.filter((F.col("_i") > 20) & (F.lit(live) | F.col("exit_d").isNotNull()) & (F.col("_mean20") > 0) & (F.col("_c1") > 0))
    rows = rows.withColumn("ratios", F.transform("_last5", lambda x: x / F.col("_mean20")))
    rows = rows.select(*keys(symbol), F.col(d).alias("session"), F.col("close").alias("j_close"), "entry_d", "entry_open", "exit_d", "exit_close", "ratios",
                       F.array_max("ratios").alias("max_pre_ratio"), (F.aggregate("ratios", F.lit(0.0), lambda a, x: a + x) / 5.0).alias("avg_pre_ratio"),
                       F.array_sort("ratios")[2].alias("median_pre_ratio"), change("close", "_c1").alias("var_j"))
    placed = event_to_session(events, bars, symbol=symbol, d=d)
    return placed.join(rows, [*keys(symbol), "session"])


def drift_signals(measures: DataFrame, compression: float = 0.7, surprise: float = 0.10, mode: str = "all", n_of_5: int = 5) -> DataFrame:
    """Compressed before the event (all, avg, median or n_of_5 of the five ratios below the threshold) and a move of at least the
    surprise threshold on J; ``pnl_pct`` is signed by the side taken."""
    calm = {"all": F.forall("ratios", lambda x: x < compression), "avg": F.col("avg_pre_ratio") < compression, "median": F.col("median_pre_ratio") < compression,
            "n_of_5": F.size(F.filter("ratios", lambda x: x < compression)) >= n_of_5}[mode]
    side = F.when(F.col("var_j") >= surprise, "long").when(F.col("var_j") <= -surprise, "short")
    raw = change_pct("exit_close", "entry_open")
    out = measures.withColumns({"direction": side, "raw_ret_pct": raw, "var_j_pct": F.col("var_j") * 100.0}).filter(calm & F.col("direction").isNotNull() & (F.col("entry_open").isNull() | (F.col("entry_open") > 0)))
    return out.withColumn("pnl_pct", F.when(F.col("direction") == "long", F.col("raw_ret_pct")).otherwise(-F.col("raw_ret_pct"))).drop("ratios")


def pead_signals(bars: DataFrame, events: DataFrame, compression: float = 0.7, surprise: float = 0.10, mode: str = "all", n_of_5: int = 5, live: bool = False, *, symbol="symbol", d="d") -> DataFrame:
    """The signals of every event; with ``live`` also those whose trade is not over."""
    return drift_signals(drift_measures(bars, events, live, symbol=symbol, d=d), compression, surprise, mode, n_of_5)


def pead_backtest(bars: DataFrame, events: DataFrame, universe: DataFrame, *, symbol="symbol", d="d", **params) -> DataFrame:
    """The signals of the tickers of a universe with its dimension columns."""
    inside = events.join(universe, keys(symbol), "left_semi")
    return enrich_with_dimension(pead_signals(bars, inside, symbol=symbol, d=d, **params), universe, symbol)


def backtest_summary(signals: DataFrame, by=()) -> DataFrame:
    """Number of signals and sides, win rate, mean, median, best and worst, and per side."""
    p, long = F.col("pnl_pct"), F.col("direction") == "long"
    win = F.when(p > 0, 100.0).otherwise(0.0)
    return signals.groupBy(*(keys(by) if by else [])).agg(
        F.count(F.lit(1)).alias("n_signals"), count_where(long).alias("n_long"), count_where(~long).alias("n_short"), F.avg(win).alias("win_rate"), F.avg(p).alias("avg_pnl"),
        median(p).alias("median_pnl"), F.max(p).alias("best_pnl"), F.min(p).alias("worst_pnl"), F.avg(F.when(long, win)).alias("long_win_rate"),
        F.avg(F.when(~long, win)).alias("short_win_rate"), mean_where(p, long).alias("long_avg_pnl"), mean_where(p, ~long).alias("short_avg_pnl"))


def parameter_sweep(bars: DataFrame, events: DataFrame, configs, *, symbol="symbol", d="d") -> DataFrame:
    """The summary for several parameter sets, dicts with ``name`` and the arguments of ``drift_signals``. The measures are computed once; each
    event is kept for the sets it satisfies."""
    base = drift_measures(bars, events, symbol=symbol, d=d)
    parts = F.array_compact(F.array(*[F.when(_fits(c), F.lit(c["name"])) for c in configs]))
    rows = base.withColumn("direction", F.when(F.col("var_j") > 0, "long").otherwise("short")).select("*", F.explode(parts).alias("config"))
    raw = change_pct("exit_close", "entry_open")
    rows = rows.filter(F.col("entry_open") > 0).withColumn("pnl_pct", F.when(F.col("direction") == "long", raw).otherwise(-raw))
    return backtest_summary(rows, "config")


def _fits(config) -> Column:
    c, mode = config.get("compression", 0.7), config.get("mode", "all")
    calm = {"all": F.forall("ratios", lambda x: x < c), "avg": F.col("avg_pre_ratio") < c, "median": F.col("median_pre_ratio") < c,
            "n_of_5": F.size(F.filter("ratios", lambda x: x < c)) >= config.get("n_of_5", 5)}[mode]
    sides = {"long": F.col("var_j") >= config.get("surprise", 0.10), "short": F.col("var_j") <= -config.get("surprise", 0.10)}
    side = config.get("side")
    moved = sides[side] if side else sides["long"] | sides["short"]
    return calm & moved


def labelled(value, edges, labels) -> Column:
    """Label by upper edges: the first label below the first edge and so on; unknown for null."""
    v, out = as_col(value), F.when(as_col(value).isNull(), "unknown")
    for e, name in zip(edges, labels):
        out = out.when(v < e, name)
    return out.otherwise(labels[-1])


def enrich_signals(signals: DataFrame, bars: DataFrame, levels: DataFrame, *, symbol="symbol", d="d", session="session") -> DataFrame:
    """Calendar, capitalisation, analyst, surprise, beta, 20-day pre-trend and volatility-level buckets of each signal. ``signals`` carries market_cap_b,
    n_analysts and beta; the level is the last close at or before the session."""
    w = sessions(symbol, d)
    # past holds up to 21 closes before the session; at least 20 are needed
    past = bars.select(*keys(symbol), F.col(d).alias(session), F.coalesce(F.lag("close", 21).over(w), F.lag("close", 20).over(w)).alias("_c0"), F.lag("close").over(w).alias("_c1"))
    out = signals.join(past, [*keys(symbol), session], "left")
    trend = F.when(F.col("_c0") > 0, change_pct("_c1", "_c0"))
    out = asof_join(out, levels.select(F.col(d).alias(session), F.col("close").alias("vix_at_j")), on=session)
    cap = F.col("market_cap_b")
    width = F.when(cap < 100, 10).otherwise(100)
    low = (F.floor(cap / width) * width).cast("int")
    n = F.coalesce(F.col("n_analysts").cast("int"), F.lit(0))
    analysts = F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 10, "6-10").when(n <= 15, "11-15").when(n <= 20, "16-20").when(n <= 30, "21-30").otherwise("31+")
    out = out.withColumns({"month": F.month(session), "weekday": F.weekday(session), "year": F.year(session), "pre_trend_20d_pct": trend})
    return out.withColumns({
        "cap_bucket": F.when(cap.isNull(), "unknown").otherwise(F.concat(F.lit("["), low.cast("string"), F.lit("-"), (low + width).cast("string"), F.lit("B]"))),
        "analyst_bucket": analysts, "surprise_bucket": labelled(F.abs("var_j_pct"), (12, 15, 20, 30), ("10-12%", "12-15%", "15-20%", "20-30%", "30%+")),
        "beta_bucket": labelled("beta", (0.8, 1.2, 1.6), ("low", "normal", "high", "very_high")),
        "pre_trend_bucket": labelled("pre_trend_20d_pct", (-10, -3, 3, 10), ("strong_down", "down", "flat", "up", "strong_up")),
        "vix_regime": labelled("vix_at_j", (15, 20, 25, 30), ("calm", "normal", "elevated", "stressed", "crisis")),
        "vix_broad": labelled("vix_at_j", (18,), ("low", "high"))}).drop("_c0", "_c1")


def _trade_stats():
    p = F.col("pnl_pct")
    return [F.count(F.lit(1)).alias("n"), F.avg(F.when(p > 0, 100.0).otherwise(0.0)).alias("win_rate"), F.avg(p).alias("avg_pnl"), median(p).alias("median_pnl")]


def bucket_stats(signals: DataFrame, col: str, min_n: int = 3) -> DataFrame:
    """Trades, win rate, mean and median per bucket with at least ``min_n`` trades."""
    return signals.groupBy(col).agg(*_trade_stats()).filter(F.col("n") >= min_n)


def cross_buckets(signals: DataFrame, combinations, min_n: int = 3, min_win_rate: float = 75.0) -> DataFrame:
    """Every given combination of bucket columns in one grouping-sets query; combinations that reach the win rate. ``combo`` names the
    columns grouped by; columns outside the combination are null."""
    cols = sorted({c for combo in combinations for c in combo})
    out = signals.groupingSets([[F.col(c) for c in combo] for combo in combinations], *cols).agg(F.grouping_id().alias("_g"), *_trade_stats())
    names = None
    for combo in combinations:
        gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in combo)
        label = F.lit(" x ".join(combo))
        names = F.when(F.col("_g") == gid, label) if names is None else names.when(F.col("_g") == gid, label)
    return out.withColumn("combo", names).drop("_g").filter((F.col("n") >= min_n) & (F.col("win_rate") >= min_win_rate))


def money(text) -> Column:
    """'12.3B', '450M' or '7K' as a number."""
    text = F.trim(as_col(text).cast("string"))
    number = F.regexp_extract(text, r"^\$?([0-9.]+)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"([KMBkmb])$", 1))
    return number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def build_universe(tickers: DataFrame, cap_min: float, cap_max: float, exclude_sectors=(), *, symbol="symbol", cap="market_cap", sector="sector") -> DataFrame:
    """Tickers of a capitalisation range outside the excluded sectors, ordered by number of analysts."""
    out = tickers.filter(F.col(cap).between(cap_min, cap_max))
    if exclude_sectors:
        out = out.filter(~F.col(sector).isin(list(exclude_sectors)))
    return out.orderBy("n_analysts", symbol)


def beta_screen(tickers: DataFrame, min_beta: float = 2.0, min_cap: float = 1e9, *, cap_text="cap_text") -> DataFrame:
    """Tickers of high beta above a capitalisation given as text with a K, M or B suffix."""
    return tickers.withColumn("cap_usd", money(cap_text)).filter((F.col("cap_usd") >= min_cap) & (F.col("beta") >= min_beta))


def daily_scan(bars: DataFrame, events: DataFrame, asof, window: int = 3, compression: float = 0.7, surprise: float = 0.10, mode: str = "all", *, symbol="symbol", d="d"):
    """Around a day: tickers with an event in the next ``window`` days whose last five ranges are all below the threshold of the mean of the last twenty, and
    signals of events of the day and the day before, which can be acted on: entry, exit and result are null as far as they lie ahead.
    Returns (pre_event, signals). Bars after ``asof`` count nowhere."""
    today = F.lit(asof).cast("date")
    near = events.filter(F.col(d).between(F.date_sub(today, window), F.date_add(today, window))).withColumn("days_until", F.datediff(d, today))
    known = bars.filter(F.col(d) <= today)
    newest = known.withColumn("_r", F.row_number().over(Window.partitionBy(*keys(symbol)).orderBy(F.col(d).desc()))).filter("_r <= 20")
    span = F.col("high") - F.col("low")
    state = newest.groupBy(*keys(symbol)).agg(F.avg(span).alias("_mean"), F.max(F.when(F.col("_r") <= 5, span)).alias("_max5"))
    state = state.select(*keys(symbol), F.try_divide(F.col("_max5"), F.col("_mean")).alias("compression_ratio"))
    pre = near.filter("days_until > 0").join(state, keys(symbol)).filter(F.col("compression_ratio") < compression)
    due = near.filter("days_until BETWEEN -1 AND 0")
    return pre, pead_signals(known, due, compression, surprise, mode, live=True, symbol=symbol, d=d)


# The wings tried (style, inner or only wing, outer wing) and the verdict limits.
WINGS = (("pur", 30.0, None), ("pur", 40.0, None), ("zone", 20.0, 40.0), ("zone", 15.0, 40.0))
VERDICTS = ((8.0, "excellent"), (3.0, "viable"), (0.5, "marginal"))


def verdict(gain) -> Column:
    gain = as_col(gain)
    out = F.when(gain >= VERDICTS[0][0], VERDICTS[0][1])
    for limit, name in VERDICTS[1:]:
        out = out.when(gain >= limit, name)
    return out.otherwise("unprofitable")


def atm_strikes(chains: DataFrame, call_only: bool = False, *, chain="chain_id") -> DataFrame:
    """The at-the-money strike of each chain: both deltas nearest to one half, or the call's alone; the lower strike on ties."""
    score = F.abs(F.col("call_delta") - 0.5)
    if not call_only:
        score = score + F.abs(F.abs("put_delta") - 0.5)
    return chains.groupBy(chain).agg(F.min_by("strike", F.struct(score, F.col("strike"))).alias("atm"))


def price_structures(chains: DataFrame, wings=WINGS, call_only: bool = False, *, chain="chain_id") -> DataFrame:
    """Per chain and wing setting the debit and credit of the bought and sold four-leg structure from bid and ask at the nearest strikes, their largest gain
    and verdict, and the best structure of the chain.

    Each setting needs four quotes per chain; they are picked by one grouping per (chain, leg).
    """
    atm = atm_strikes(chains, call_only, chain=chain)
    offsets = sorted({0.0} | {w for _, a, b in wings for w in (a, b) if w is not None} | {-w for _, a, b in wings for w in (a, b) if w is not None})
    legs = F.inline(F.array(*[F.struct(F.lit(f"{o:+g}").alias("leg"), (F.col("atm") + o).alias("target")) for o in offsets]))
    quotes = nearest_strike(chains, atm.select(chain, legs), chain=chain)
    wide = quotes.groupBy(chain).agg(*[F.max(F.when(F.col("leg") == f"{o:+g}", F.col(c))).alias(f"{c}{o:+g}") for o in offsets for c in ("call_bid", "call_ask", "put_bid", "put_ask")])
    wide = wide.join(atm, chain)
    q = lambda c, o: F.col(f"`{c}{o + 0.0:+g}`")  # noqa: E731  (adding 0.0 avoids "-0")
    rows = []
    for style, inner, outer in wings:
        near, far = (0.0, inner) if style == "pur" else (inner, outer)
        debit = q("call_ask", near) + q("put_ask", -near) - q("call_bid", far) - q("put_bid", -far)
        credit = q("call_bid", near) + q("put_bid", -near) - q("call_ask", far) - q("put_ask", -far)
        names = ("RIC", "IC") if style == "pur" else ("RIB", "IB")
        label = f"pur {inner:g}" if style == "pur" else f"zone {inner:g}-{outer:g}"
        rows.append(F.struct(F.lit(label).alias("setting"), F.lit(names[0]).alias("long_name"), F.lit(names[1]).alias("short_name"), debit.alias("debit"), credit.alias("credit"),
                             (F.lit(far - near) - debit).alias("long_max_gain"), credit.alias("short_max_gain")))
    out = wide.select(chain, "atm", F.inline(F.array(*rows)))
    best = F.greatest("long_max_gain", "short_max_gain")
    out = out.withColumns({"long_verdict": verdict("long_max_gain"), "short_verdict": verdict("short_max_gain"), "_best": best})
    return out.withColumn("is_best", F.row_number().over(Window.partitionBy(chain).orderBy(F.col("_best").desc(), "setting")) == 1).drop("_best")


def interpolate_by_level(points: DataFrame, table: DataFrame, *, level="level", at="x", by=()) -> DataFrame:
    """Linear interpolation of every value column of ``table`` between its levels, clamped at the ends. The level table is a small dimension: one row
    per level; points are matched to the bracket that holds them by range within ``by``."""
    by = keys(by) if by else []
    values = [c for c in table.columns if c not in (*by, level)]
    w = Window.partitionBy(F.lit(1), *by).orderBy(level)
    brackets = table.select(*by, F.col(level).alias("_lo"), F.lead(level).over(w).alias("_hi"), F.lag(level).over(w).alias("_prev"), *[F.col(c).alias(f"_lo_{c}") for c in values],
                            *[F.lead(c).over(w).alias(f"_hi_{c}") for c in values])
    packed = brackets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_lo", "_hi", *[f"_lo_{c}" for c in values], *[f"_hi_{c}" for c in values]))).alias("_b"))
    rows = points.join(packed, by, "left") if by else points.withColumn("_b", packed.select("_b").scalar())
    x = F.col(at)
    below = F.filter("_b", lambda b: b["_lo"] <= x)
    rows = rows.withColumn("_p", F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.col("_b")[0]))
    share = F.when(x <= F.col("_p._lo"), 0.0).when(F.col("_p._hi").isNull(), 0.0).otherwise((x - F.col("_p._lo")) / (F.col("_p._hi") - F.col("_p._lo")))
    rows = rows.withColumn("_s", share)
    return rows.withColumns({c: F.col(f"_p._lo_{c}") * (F.lit(1.0) - F.col("_s")) + F.coalesce(F.col(f"_p._hi_{c}"), F.lit(0.0)) * F.col("_s") for c in values}).drop("_b", "_p", "_s")


def structure_pnl(rows: DataFrame, wing: float = 40.0, inner: float = 20.0, outer: float = 40.0) -> DataFrame:
    """Piecewise result of the four structures for each occurrence: (structure, pnl) rows. ``rows`` carries amplitude_hl (high - low), move_abs (|close - open|) and, per structure,
    its largest gain: ric_gain, ic_gain, rib_gain, ib_gain (the debit of a bought structure is its width less the gain)."""
    hl, move = F.col("amplitude_hl"), F.col("move_abs")
    half = wing * 0.5
    gain, debit = F.col("ric_gain"), F.lit(wing) - F.col("ric_gain")
    part = (move - half) / half
    ric = F.when(move >= wing, gain).when(move >= half, part * gain - (1 - part) * debit).otherwise(F.greatest(-debit * (F.lit(1.0) - move / half) * 0.8, -debit))
    credit = F.col("ic_gain")
    ic = F.when(hl <= wing * 0.6, credit).when(hl <= wing, (F.lit(wing) - hl) / (wing * 0.4) * credit).otherwise(F.greatest(credit - (hl - wing) * 1.2, credit - wing))
    gain2, debit2 = F.col("rib_gain"), F.lit(outer - inner) - F.col("rib_gain")
    rib = F.when(move >= outer, gain2).when(move >= inner, (move - inner) / (outer - inner) * gain2).otherwise(F.greatest(-debit2 * (F.lit(1.0) - move / inner), -debit2))
    credit2 = F.col("ib_gain")
    ib = F.when(hl <= inner, credit2).when(hl <= outer, (F.lit(outer) - hl) / (outer - inner) * credit2).otherwise(F.greatest(credit2 - (hl - outer), credit2 - outer))
    parts = F.array(*[F.struct(F.lit(k).alias("structure"), v.alias("pnl")) for k, v in (("RIC", ric), ("IC", ic), ("RIB", rib), ("IB", ib))])
    return rows.select("*", F.inline(parts))


def structure_summary(trades: DataFrame, by=()) -> DataFrame:
    """Trades, win rate, mean, total, best and worst per structure; the one with the best mean is marked."""
    group = keys(by) if by else []
    p = F.col("pnl")
    out = trades.groupBy(*group, "structure").agg(F.count(F.lit(1)).alias("n_trades"), (F.avg(F.when(p > 0, 1.0).otherwise(0.0)) * 100.0).alias("win_rate"), F.avg(p).alias("avg_pnl"),
                                                  F.sum(p).alias("total_pnl"), F.max(p).alias("max_gain"), F.min(p).alias("max_loss"))
    order = Window.partitionBy(F.lit(1), *group).orderBy(F.col("avg_pnl").desc(), "structure")
    return out.withColumn("is_best", F.row_number().over(order) == 1)


def feedback_summary(log: DataFrame) -> DataFrame:
    """Rows by label, by engine and label, and by version and label in one grouping-sets query (unused keys null)."""
    c = F.col
    return log.groupingSets([[c("label")], [c("engine"), c("label")], [c("app_version"), c("label")]], "label", "engine", "app_version").agg(F.count(F.lit(1)).alias("n"))


def latest_per_label(log: DataFrame, n: int = 10, *, ts="ts", tie="event_id") -> DataFrame:
    """The latest n rows of each label. The rank limit is applied in every task before the shuffle, so a frequent
    label sends at most n rows per task."""
    order = Window.partitionBy("label").orderBy(F.col(ts).desc(), F.col(tie).desc())
    return log.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
