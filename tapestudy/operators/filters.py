"""Filters and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StructType

from ..functions.columns import (
    add_minutes, as_col, compare, contains_any, count_where, hhmm, mean_where, median, minute_of_day, truth,
)
from ..functions.windows import keys, sessions
from .series import returns


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def filter_period(df: DataFrame, *, years=None, date_from=None, date_to=None, months=None, d="d") -> DataFrame:
    """B1: inclusive date range and/or year set and months. A single year is ignored when
    ``date_from`` is given; a list of years is not."""
    out = df
    if date_from is not None:
        out = out.filter(F.col(d) >= as_date(date_from))
    if date_to is not None:
        out = out.filter(F.col(d) <= as_date(date_to))
    if isinstance(years, int):
        years = None if date_from is not None else [years]
    if years:
        out = out.filter(F.year(d).isin(list(years)))
    if months:
        out = out.filter(F.month(d).isin(list(months)))
    return out


def relative_period(n: int | None, unit: str, asof) -> tuple[Column, Column]:
    """B2: bounds of "the last n days, weeks, months or years", "ytd" or "since" a year, up to ``asof``."""
    end = as_date(asof)
    start = {
        "days": lambda: F.date_sub(end, n), "weeks": lambda: F.date_sub(end, 7 * n),
        "months": lambda: F.add_months(end, -n), "years": lambda: F.add_months(end, -12 * n),
        "ytd": lambda: F.trunc(end, "year"), "since": lambda: F.lit(dt.date(n, 1, 1)),
    }[unit]()
    return start, end


def filter_calendar(df: DataFrame, *, year=None, month=None, weekday=None, quarter=None, d="d") -> DataFrame:
    """Calendar filters; weekday 0 is Monday. Each takes a value or a list."""
    for value, fn in ((year, F.year), (month, F.month), (weekday, F.weekday), (quarter, F.quarter)):
        if value is not None:
            df = df.filter(fn(d).isin(value if isinstance(value, (list, tuple)) else [value]))
    return df


def threshold(col, op: str, value, upper=None) -> Column:
    """Comparison with a level; ``=`` is approximate, ``between`` inclusive."""
    return compare(col, op, value, upper)


def boolean_expr(tree) -> Column:
    """A nested tree of ``("and", a, b, ...)``, ``("or", ...)`` and ``("not", a)`` over conditions
    (columns or names of boolean columns) as one column. A null condition is false before negation."""
    if isinstance(tree, (tuple, list)):
        head, *parts = tree
        parts = [boolean_expr(p) for p in parts]
        if head == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if head == "and" else (out | p)
        return out
    return truth(tree)


def boolean_filter(df: DataFrame, tree) -> DataFrame:
    """Rows where the tree holds."""
    return df.filter(boolean_expr(tree))


def dates_where(df: DataFrame, cond, *, d="d") -> DataFrame:
    """The distinct days on which a condition holds."""
    return df.filter(as_col(cond)).select(d).distinct()


def restrict_to_dates(df: DataFrame, *date_sets: DataFrame, d="d") -> DataFrame:
    """Rows whose day is in every date set."""
    for dates in date_sets:
        df = df.join(dates, [d], "left_semi")
    return df


def overnight_dates(df: DataFrame, direction: str = "positive", *, symbol="symbol", d="d") -> DataFrame:
    """(symbol, d) of sessions opening above (or below) the previous close."""
    full = df.filter(F.col("open").isNotNull() & F.col("close").isNotNull())
    prev = F.lag("close").over(sessions(symbol, d))
    out = full.select(*keys(symbol), d, "open", prev.alias("_prev"))
    hit = F.col("open") > F.col("_prev") if direction == "positive" else F.col("open") < F.col("_prev")
    return out.filter(hit).select(*keys(symbol), d)


def calendar_event_dates(cal: DataFrame, keywords, surprise: str | None = None, *, d="d", event="event") -> DataFrame:
    """Days with an event whose text holds a keyword, optionally with actual above or below estimate."""
    out = cal.filter(contains_any(event, keywords))
    if surprise == "positive":
        out = out.filter(F.col("actual") > F.col("estimate"))
    elif surprise == "negative":
        out = out.filter(F.col("actual") < F.col("estimate"))
    return out.select(d).distinct()


def exclude_event_window(df: DataFrame, events: DataFrame, before: int = 5, after: int = 5, *, symbol="symbol",
                         d="d") -> DataFrame:
    """Drop rows within ``before``/``after`` calendar days around an event of the same symbol.

    The events are spread to the days they block, so the exclusion is an equality anti-join.
    """
    near = F.explode(F.sequence(F.date_sub(d, before), F.date_add(d, after)))
    blocked = events.select(*keys(symbol), d).distinct().select(*keys(symbol), near.alias(d)).distinct()
    return df.join(blocked, [*keys(symbol), d], "left_anti")


# known when a bar or day begins
KNOWN_AT_OPEN = ("symbol", "ts", "d", "minute_of_day", "freq_min", "open")


def measures(df: DataFrame, keep) -> list[str]:
    """Columns that are hidden while a bar is open: all outside ``keep``, whatever their type."""
    return [c for c in df.columns if c not in keep]


def ex_ante_mask_intraday(df: DataFrame, at, freq_min: int, mode: str = "generic", *, ts="ts", keep=KNOWN_AT_OPEN) -> DataFrame:
    """What is known at time ``at`` (a timestamp, its text, or a column): closed bars in full, a bar in progress by its
    keys and open (``keep``) only, later bars dropped. A bar starting at ``at`` shows its open, or nothing in mode ``before_open``."""
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    start, end = F.col(ts), add_minutes(ts, freq_min)
    closed = end <= at
    visible = closed | (start < at) | ((start == at) & F.lit(mode != "before_open"))
    masked = {c: F.when(closed, F.col(c)) for c in measures(df, (*keep, ts))}
    return df.filter(visible).withColumns(masked | {"full_candle": closed})


def ex_ante_mask_daily(df: DataFrame, at, mode: str = "generic", *, d="d", keep=KNOWN_AT_OPEN) -> DataFrame:
    """Earlier days in full; the day itself by its keys and open only (``generic``, ``at_open``) or not at all."""
    day = at if isinstance(at, Column) else F.lit(at).cast("date")
    earlier = F.col(d) < day
    same = (F.col(d) == day) & F.lit(mode in ("generic", "at_open"))
    masked = {c: F.when(earlier, F.col(c)) for c in measures(df, (*keep, d))}
    return df.filter(earlier | same).withColumns(masked | {"full_candle": earlier})


def time_window(df: DataFrame, start: str = "09:30", end: str = "16:00", inclusive: str = "both", *,
                minute="minute_of_day") -> DataFrame:
    """Rows whose clock time lies in the window; ``inclusive`` is both or left."""
    m = F.col(minute) if minute in df.columns else minute_of_day("ts")
    upper = m <= hhmm(end) if inclusive == "both" else m < hhmm(end)
    return df.filter((m >= hhmm(start)) & upper)


session_filter = time_window


def value_range_pair(df: DataFrame, j0_range, j1_range, *, symbol="symbol", d="d"):
    """Sessions whose change lies in ``j0_range`` and whose next change lies in ``j1_range``.

    Returns (summary per symbol, matching rows).
    """
    rows = returns(df, symbol=symbol, d=d).filter(F.col("var_pct").isNotNull())
    j0 = F.col("var_pct").between(*j0_range)
    known = j0 & F.col("next_var").isNotNull()
    both = known & F.col("next_var").between(*j1_range)
    summary = rows.groupBy(*keys(symbol)).agg(
        F.count(F.lit(1)).alias("n_total"), count_where(j0).alias("n_j0"), count_where(known).alias("n_j0_eval"),
        count_where(both).alias("n_both"), mean_where("next_var", known).alias("mean_j1"),
        median(F.when(known, F.col("next_var"))).alias("median_j1"))
    summary = summary.withColumns({
        "pct_j0": F.try_divide(F.col("n_j0").cast("double"), "n_total") * 100.0,
        "pct_both": F.try_divide(F.col("n_both").cast("double"), "n_j0_eval") * 100.0})
    return summary, rows.filter(both).select(*keys(symbol), d, "close", "var_pct", "next_var")


def intraday_value_at(df: DataFrame, at: str, op: str | None = None, level: float | None = None, *, value="close",
                      symbol="symbol", d="d", minute="minute_of_day") -> DataFrame:
    """The value of each day's bar at a clock time, optionally beyond a level."""
    out = df.filter(F.col(minute) == hhmm(at)).select(*keys(symbol), d, F.col(value).alias("value"))
    return out if op is None else out.filter(compare("value", op, level))
