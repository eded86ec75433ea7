"""Joins of series: alignment, as-of, event-to-session, pairs, nearest strike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.columns import minutes_between, truth
from ..functions.windows import keys, sessions


def align(frames: dict[str, DataFrame], on="d", how: str = "inner") -> DataFrame:
    """Join series on their keys, prefixing the other columns with the series name."""
    on = keys(on)
    renamed = [df.select(*on, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in on])
               for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, on, how), renamed)


def left_merge_conditions(base: DataFrame, conditions: dict[str, DataFrame], on="d") -> DataFrame:
    """One boolean column per condition; ``conditions`` maps a name to the dates where it holds."""
    for name, dates in conditions.items():
        marked = dates.select(*keys(on)).distinct().withColumn(name, F.lit(True))
        base = base.join(marked, keys(on), "left").withColumn(name, truth(name))
    return base


def _chunk(t: Column, unit: str) -> Column:
    day = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))
    return {"year": lambda: F.year(t), "month": lambda: F.year(t) * 12 + F.month(t), "day": lambda: day,
            "hour": lambda: day * 24 + F.hour(t)}[unit]()


def asof_join(left: DataFrame, right: DataFrame, *, on: str, by=(), right_on: str | None = None, columns=None,
              direction: str = "backward", tolerance=None, allow_exact: bool = True, tie: str = "earlier",
              chunk: str | None = None, right_time: str | None = None, right_unique: bool = False) -> DataFrame:
    """For each left row the last right row at or before it (``backward``), the first at or after it
    (``forward``), or the closer of the two (``nearest``).

    ``tolerance`` is in days for date keys and in minutes for timestamps. ``tie`` settles equal
    distances. Of several right rows with one key the greatest values win (``right_unique`` says that there is only one). ``right_time`` names a
    column for the matched time. Chunks are years of dates or days of timestamps unless ``chunk`` names another unit.

    The match is computed once per distinct left key, inside groups of (by, time chunk), and joined back by
    equality. A hot ``by`` value is thereby cut by time, and repeated keys never reach a window. What a
    chunk needs from its neighbours arrives as two summary rows per chunk.
    """
    by = keys(by) if by else []
    right_on = right_on or on
    columns = list(columns) if columns is not None else [c for c in right.columns if c not in (*by, right_on)]
    is_date = isinstance(left.schema[on].dataType, DateType)
    chunk = chunk or ("year" if is_date else "day")

    t = F.col("_t")
    want = left.select(*by, F.col(on).alias("_t")).filter(t.isNotNull()).distinct()
    have = right.select(*by, F.col(right_on).alias("_t"), *columns).filter(t.isNotNull())
    value = F.struct(F.col("_t").alias("_rt"), *columns)
    have = have.select(*by, "_t", value.alias("_v")) if right_unique else have.groupBy(*by, "_t").agg(F.max(value).alias("_v"))
    rows = (want.withColumn("_right", F.lit(0)).unionByName(have.withColumn("_right", F.lit(1)), allowMissingColumns=True)
            .withColumns({"_chunk": _chunk(t, chunk), "_pos": F.lit(0)}))

    stamp = F.when(F.col("_right") == 1, t)
    ends = rows.groupBy(*by, "_chunk").agg(F.max_by("_v", stamp).alias("_last"), F.min_by("_v", stamp).alias("_first"))
    across = Window.partitionBy(*by).orderBy("_chunk")
    before = F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", True).over(across.rowsBetween(1, Window.unboundedFollowing))
    carried = ends.select(*by, "_chunk", before.alias("_before"), after.alias("_after"))
    carried = carried.select(*by, "_chunk", F.explode(F.array(
        F.struct(F.lit(-1).alias("_pos"), F.col("_before").alias("_v")),
        F.struct(F.lit(1).alias("_pos"), F.col("_after").alias("_v")))).alias("_x"))
    carried = carried.select(*by, "_chunk", "_x._pos", "_x._v", F.lit(1).alias("_right"))
    rows = rows.unionByName(carried, allowMissingColumns=True)

    def ordered(right_first: bool):
        side = F.col("_right").desc() if right_first else F.col("_right").asc()
        return Window.partitionBy(*by, "_chunk").orderBy("_pos", "_t", side)

    back = F.last("_v", True).over(ordered(allow_exact).rowsBetween(Window.unboundedPreceding, 0))
    # looking forward, an exact match is visible only if it sorts after the left row
    ahead_first = not allow_exact or direction == "nearest"
    ahead = F.first("_v", True).over(ordered(ahead_first).rowsBetween(0, Window.unboundedFollowing))
    if direction == "backward":
        rows = rows.withColumn("_m", back)
    elif direction == "forward":
        rows = rows.withColumn("_m", ahead)
    else:
        rows = rows.withColumns({"_b": back, "_f": ahead})

    def gap(later, earlier):
        return F.datediff(later, earlier).cast("double") if is_date else minutes_between(later, earlier)

    match = rows.filter((F.col("_right") == 0) & (F.col("_pos") == 0))
    if direction == "nearest":
        gap_b, gap_f = gap(t, F.col("_b._rt")), gap(F.col("_f._rt"), t)
        prefer_back = gap_b <= gap_f if tie == "earlier" else gap_b < gap_f
        match = match.withColumn("_m", F.when(F.col("_f").isNull() | (F.col("_b").isNotNull() & prefer_back), F.col("_b"))
                                 .otherwise(F.col("_f")))
    if tolerance is not None:
        match = match.withColumn("_m", F.when(F.abs(gap(t, F.col("_m._rt"))) <= tolerance, F.col("_m")))
    found = match.select(*by, t.alias(on), *[F.col(f"_m.{c}").alias(c) for c in columns],
                         *([F.col("_m._rt").alias(right_time)] if right_time else []))
    return left.join(found, [*by, on], "left")


def spread_nearest(series: DataFrame, tolerance_days: int = 2, tie: str = "later", *, by="series", d="d",
                   value="value") -> DataFrame:
    """The nearest value of every series for every calendar day within the tolerance.

    Each row is offered to the few days around it and the closest offer per day is kept, so a later
    match on the day is a plain equality join. ``tie`` settles equal distances.
    """
    offers = series.filter(F.col(value).isNotNull()).select(
        *keys(by), F.col(value).alias("_v"), F.col(d).alias("_src"),
        F.explode(F.sequence(F.date_sub(d, tolerance_days), F.date_add(d, tolerance_days))).alias(d))
    signed = F.datediff("_src", d)
    rank = F.abs(signed) * 2 + F.when((signed > 0) == F.lit(tie == "earlier"), 1).otherwise(0)
    return offers.groupBy(*keys(by), d).agg(F.min_by("_v", rank).alias(value))


def ffill_to_index(series: DataFrame, index: DataFrame, *, by="series", d="d") -> DataFrame:
    """C4: every series on the days of ``index``, carrying the last value forward.

    A row covers the calendar days until the next row of its series; those days are matched to the index by
    equality, so no series-by-index product is formed.
    """
    by = keys(by)
    values = [c for c in series.columns if c not in (*by, d)]
    bound = index.agg(F.max(d).alias("_end"))
    until = F.coalesce(F.date_sub(F.lead(d).over(sessions(by, d)), 1), F.col("_end"))
    # one bound row: the last day of the index
    spans = series.withColumn("_end", bound.scalar()).withColumn("_until", until).filter(F.col("_until") >= F.col(d))
    days = spans.select(*by, *values, F.explode(F.sequence(d, "_until")).alias(d))
    return days.join(index.select(d).distinct(), [d], "left_semi")


def event_to_session(events: DataFrame, bars: DataFrame, *, symbol="symbol", d="d", timing="timing", name="session") -> DataFrame:
    """The reaction session of each event: the first session on or after its day when reported before
    the open (``bmo``), otherwise the first one on or after the next day."""
    target = F.when(F.lower(timing) == "bmo", F.col(d)).otherwise(F.date_add(d, 1))
    days = bars.select(*keys(symbol), F.col(d).alias("_s")).distinct()
    wanted = events.withColumn("_s", target)
    return asof_join(wanted, days, on="_s", by=symbol, columns=[], direction="forward", right_time=name, right_unique=True).drop("_s")


def semi_dates(df: DataFrame, dates: DataFrame, on="d") -> DataFrame:
    """Rows whose day is in the set."""
    return df.join(dates, keys(on), "left_semi")


def anti_dates(df: DataFrame, dates: DataFrame, on="d") -> DataFrame:
    """Rows whose day is not in the set."""
    return df.join(dates, keys(on), "left_anti")


def pairwise_join(long: DataFrame, families: DataFrame | None = None, *, by="series", d="d", value="value") -> DataFrame:
    """All unordered pairs of series on their common days, without pairs of one family.

    The result itself holds one row per pair and day; use ``stats.correlation_catalog`` when only a
    per-pair figure is needed.
    """
    s = long.select(F.col(by).alias("_k"), d, F.col(value).alias("_v"))
    if families is not None:
        s = s.join(families.select(F.col(by).alias("_k"), "family"), "_k", "left")
    else:
        s = s.withColumn("family", F.lit(None).cast("string"))
    a = s.select(d, F.col("_k").alias("a"), F.col("_v").alias("value_a"), F.col("family").alias("_fa"))
    b = s.select(d, F.col("_k").alias("b"), F.col("_v").alias("value_b"), F.col("family").alias("_fb"))
    same = truth(F.col("_fa") == F.col("_fb"))
    return a.join(b, [d]).filter((F.col("a") < F.col("b")) & ~same).select("a", "b", d, "value_a", "value_b")


def enrich_with_dimension(df: DataFrame, dim: DataFrame, on="symbol") -> DataFrame:
    """Attach dimension columns; Spark broadcasts the dimension when its size allows."""
    return df.join(dim, keys(on), "left")


def nearest_strike(chains: DataFrame, targets: DataFrame, *, chain="chain_id", leg="leg") -> DataFrame:
    """Per (chain, leg) the quote whose strike is closest to ``target``; the lower strike on ties."""
    quotes = [c for c in chains.columns if c != chain]
    near = chains.join(targets.select(chain, leg, "target"), [chain])
    pick = F.min_by(F.struct(*quotes), F.struct(F.abs(F.col("strike") - F.col("target")), F.col("strike")))
    return near.groupBy(chain, leg).agg(pick.alias("_q")).select(chain, leg, "_q.*")
