"""Column-level helpers shared by the operators. Everything stays in built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A column from a name or a column."""
    return value if isinstance(value, Column) else F.col(value)


def change(new, old) -> Column:
    """(new - old) / old, null when old is 0 or null."""
    new, old = as_col(new), as_col(old)
    return F.try_divide(new - old, old)


def change_pct(new, old) -> Column:
    return change(new, old) * 100.0


def ratio(num, den) -> Column:
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def share_pct(cond, among=None) -> Column:
    """Aggregate: percentage of rows where ``cond`` holds (a null condition counts as false)."""
    hit = F.count_if(truth(cond) if among is None else truth(cond) & truth(among))
    total = F.count(F.lit(1)) if among is None else F.count_if(truth(among))
    return F.try_divide(hit.cast("double"), total) * 100.0


def truth(cond) -> Column:
    """A condition whose null means false, so that negating it behaves like a boolean mask."""
    return F.coalesce(as_col(cond), F.lit(False))


def flag(cond) -> Column:
    """1.0 where the condition holds, 0.0 elsewhere (nulls included)."""
    return F.when(as_col(cond), 1.0).otherwise(0.0)


def count_where(cond) -> Column:
    return F.count_if(truth(cond))


def mean_where(value, cond) -> Column:
    return F.avg(F.when(as_col(cond), as_col(value)))


def median(value) -> Column:
    return F.percentile(as_col(value), F.lit(0.5))


def close_to(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Approximate equality with an absolute and a relative tolerance."""
    a, b = as_col(a), as_col(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def compare(value, op: str, level, upper=None) -> Column:
    """``value op level``; ``=`` is approximate and ``between`` takes ``upper`` (inclusive)."""
    value = as_col(value)
    level = level if isinstance(level, Column) else F.lit(level)
    if op == ">":
        return value > level
    if op == "<":
        return value < level
    if op == ">=":
        return value >= level
    if op == "<=":
        return value <= level
    if op in ("=", "=="):
        return close_to(value, level)
    if op == "between":
        return value.between(level, upper)
    raise ValueError(f"unknown comparison {op!r}")


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def color(open_="open", close="close") -> Column:
    """1 for a green bar, -1 for a red bar, 0 for a flat one."""
    return F.signum(as_col(close) - as_col(open_)).cast("int")


def bucket(value, edges, labels=None, right_closed: bool = False) -> Column:
    """Label of the interval holding ``value``; null outside the edges. Left-closed by default."""
    value = as_col(value)
    labels = labels or [f"{lo:g}-{hi:g}" for lo, hi in zip(edges, edges[1:])]
    out = None
    for lo, hi, name in zip(edges, edges[1:], labels):
        inside = (value > lo) & (value <= hi) if right_closed else (value >= lo) & (value < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


# Accented letters and their plain forms, as they occur in French and English labels.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def plain_text(value) -> Column:
    """Lower-cased text without accents."""
    return F.translate(F.lower(as_col(value)), ACCENTED, PLAIN)


def slug(value) -> Column:
    """Lower-case identifier: accents stripped, other runs of characters become one underscore."""
    text = F.regexp_replace(plain_text(value), "[^a-z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def contains_any(value, words) -> Column:
    """True if the plain text of ``value`` contains any of the (literal) words."""
    text = plain_text(value)
    return any_of([text.contains(F.lit(w.lower())) for w in words])


def minute_of_day(ts) -> Column:
    ts = as_col(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def hhmm(text: str) -> int:
    """'09:30' -> 570."""
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def add_minutes(ts, minutes) -> Column:
    minutes = minutes if isinstance(minutes, Column) else F.lit(int(minutes))
    return as_col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))


def minutes_between(later, earlier) -> Column:
    """Minutes from ``earlier`` to ``later`` as a double, for zoned or zone-free timestamps."""
    return F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later)) / F.lit(60e6)


def sample_skewness(value) -> Column:
    """Bias-corrected skewness (Spark's own is the population form); null below three values."""
    value = as_col(value)
    n = F.count(value).cast("double")
    return F.when(n >= 3, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def pearson(a, b) -> Column:
    """Aggregate: Pearson correlation of the rows where both are present; null when a side is constant.

    Spark's own ``corr`` raises on a constant side under ANSI rules.
    """
    a, b = as_col(a), as_col(b)
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a2, b2), F.stddev_pop(a2) * F.stddev_pop(b2))
