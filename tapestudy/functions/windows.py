"""Window specs and rolling columns.

Every window is partitioned by symbol (or series) and ordered by session. Bars carry one row per
symbol and session, so a window group is bounded by the number of sessions in the calendar (about
25,000 for a century of daily bars), whatever share of the raw ticks one symbol holds: ticks are
reduced to bars by a partially aggregated ``groupBy`` before any window sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .columns import as_col


def keys(symbol) -> list[str]:
    return [symbol] if isinstance(symbol, str) else list(symbol)


def sessions(symbol="symbol", d="d"):
    """The per-symbol session window."""
    return Window.partitionBy(*keys(symbol)).orderBy(d)


def trailing(w, n: int):
    """The current row and the n-1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def whole(symbol="symbol"):
    return Window.partitionBy(*keys(symbol))


ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
}


def rolling(stat: str, value, w, n: int, min_periods: int | None = None) -> Column:
    """Rolling statistic over n rows, null until ``min_periods`` (default n) values are present."""
    value = as_col(value)
    frame = trailing(w, n)
    need = n if min_periods is None else min_periods
    return F.when(F.count(value).over(frame) >= need, ROLLING[stat](value).over(frame))


def rolling_z(value, w, n: int, min_periods: int | None = None) -> Column:
    """(x - mean) / std over n rows, null when the deviation is 0."""
    value = as_col(value)
    mean, std = rolling("mean", value, w, n, min_periods), rolling("std", value, w, n, min_periods)
    return F.try_divide(value - mean, std)


def rolling_percentile(value, q: float, w, n: int, min_periods: int | None = None) -> Column:
    """Linearly interpolated quantile over n rows."""
    value = as_col(value)
    frame = trailing(w, n)
    need = n if min_periods is None else min_periods
    return F.when(F.count(value).over(frame) >= need, F.percentile(value, F.lit(q)).over(frame))


def rolling_rank_pct(value, w, n: int, min_periods: int | None = None) -> Column:
    """Percent rank (ties averaged) of the current value among the last n, times 100."""
    value = as_col(value)
    frame = trailing(w, n)
    need = n if min_periods is None else min_periods
    seen = F.collect_list(value).over(frame)
    below = F.size(F.filter(seen, lambda x: x < value))
    equal = F.size(F.filter(seen, lambda x: x == value))
    rank = below + (equal + 1) / F.lit(2.0)
    return F.when(value.isNotNull() & (F.size(seen) >= need), rank / F.size(seen) * 100.0)


def rolling_correlation(a, b, w, n: int, min_periods: int | None = None) -> Column:
    """Pearson correlation over n rows; rows with a null on either side are skipped.

    A side that does not move in the window gives null.
    """
    a, b = as_col(a), as_col(b)
    frame = trailing(w, n)
    need = n if min_periods is None else min_periods
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a2).over(frame) * F.stddev_pop(b2).over(frame)
    return F.when(F.count(a2).over(frame) >= need, F.try_divide(F.covar_pop(a2, b2).over(frame), spread))
