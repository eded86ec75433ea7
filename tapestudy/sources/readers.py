"""Readers of bar files and side tables, text normalisation, catalog, profile, writers."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of, as_col, count_where, minute_of_day, minutes_between
from ..functions.windows import keys

# The frequency part of bar file names, in minutes.
FREQUENCIES = {"daily": 1440, "1min": 1, "1_min": 1, "5min": 5, "30min": 30, "30_min": 30, "1hour": 60, "4hours": 240}

# Words that mark a series as market context rather than a single stock.
MARKET_WORDS = [
    "vix", "skew", "vvix", "dxy", "spx", "spy", "qqq", "iwm", "gold", "oil", "silver", "copper", "dax", "ftse",
    "nikkei", "cac", "eurostoxx", "yield", "treasury", "bond", "tbill", "oanda", "put", "call", "ratio", "pcr",
    "equity", "index", "curve", "vix3m", "vix6m", "vix9d", "vix1d", "tick", "trin", "advance", "decline", "future",
    "correlation", "average", "range", "spread",
]

# Words that mark side tables and intraday files.
SIDE_TABLE_WORDS = ["calendar", "option", "chain", "earning"]
INTRADAY_WORDS = ["1min", "5min", "30min", "1hour", "4hour"]

# Series compared by their daily change instead of their level.
CHANGE_WORDS = ["dxy", "gold", "spx", "spy", "qqq", "iwm", "oil", "dax", "ftse", "nikkei"]

BAR_COLUMNS = ("time", "open", "high", "low", "close", "volume")
BAR_ALIASES = {"time": ("date", "datetime", "timestamp"), "volume": ("vol",)}
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")


def number(text, locale_aware: bool = False) -> Column:
    """Text to double: blanks (also no-break ones) and quotes removed, decimal comma accepted, bad text null.

    With ``locale_aware`` a value holding both separators takes the last one as the decimal mark.
    """
    clean = F.regexp_replace(as_col(text).cast("string"), r"[\s  ']", "")
    if locale_aware:
        comma, dot = F.instr(F.reverse(clean), ","), F.instr(F.reverse(clean), ".")
        clean = (F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(clean, F.lit("."), F.lit("")))
                 .when((comma > 0) & (dot > 0), F.replace(clean, F.lit(","), F.lit(""))).otherwise(clean))
    value = F.replace(clean, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(value), value)


def normalize_numeric(df: DataFrame, cols, locale_aware: bool = False) -> DataFrame:
    """A2: typed numbers from text columns."""
    return df.withColumns({c: number(c, locale_aware) for c in cols})


def clock(text, formats=()) -> Column:
    """Text to a zone-free timestamp, null when it does not parse."""
    text = F.trim(as_col(text).cast("string"))
    parsed = [text.try_cast("timestamp_ntz")]
    parsed += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*parsed)


def rezone(ts, src: str, dst: str) -> Column:
    """Wall-clock time of another zone; null for local times that do not exist or exist twice."""
    ts = as_col(ts)
    utc = F.convert_timezone(F.lit(src), F.lit("UTC"), ts)
    hour = F.expr("INTERVAL 1 HOUR")
    back = F.convert_timezone(F.lit("UTC"), F.lit(src), utc)
    back_later = F.convert_timezone(F.lit("UTC"), F.lit(src), utc + hour)
    back_earlier = F.convert_timezone(F.lit("UTC"), F.lit(src), utc - hour)
    unique = (back == ts) & (back_later != ts) & (back_earlier != ts)
    return F.when(unique, F.convert_timezone(F.lit("UTC"), F.lit(dst), utc))


def normalize_time(df: DataFrame, col: str = "time", *, src_tz: str | None = None, dst_tz: str = "America/New_York",
                   offset_minutes: int = 0, formats=(), name: str = "ts") -> DataFrame:
    """A3: parsed timestamps without unparseable rows; ``src_tz`` converts wall-clock time to ``dst_tz``."""
    out = df.withColumn(name, clock(col, formats)).filter(F.col(name).isNotNull())
    if offset_minutes:
        out = out.withColumn(name, F.col(name) + F.expr(f"INTERVAL {int(offset_minutes)} MINUTES"))
    if src_tz is not None:
        out = out.withColumn(name, rezone(name, src_tz, dst_tz)).filter(F.col(name).isNotNull())
    return out


SEPARATORS = (";", ",", "\t")


def header_name(text: str) -> str:
    """A column name as files write it: case, blanks, quotes and a byte-order mark do not count."""
    return "".join(c for c in text.lstrip("\ufeff").lower() if not c.isspace() and c not in "\"'")


def _headers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, first line) of every file that has a line. The driver lists files in any case; it reads one line of each."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    first = lines.withColumn("_i", F.monotonically_increasing_id()).filter("_start = 0").groupBy("_file").agg(F.min_by("value", "_i").alias("_head"))
    return sorted((r["_file"], r["_head"]) for r in first.collect())


def separator_of(header: str) -> str:
    """The most frequent separator of a header; of equal ones a semicolon before a comma before a tab."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s))) if any(s in header for s in SEPARATORS) else ","


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator of the files' headers; an error if they differ (read_text_table takes each file's own)."""
    found = sorted({separator_of(head) for _, head in _headers(spark, path)})
    if len(found) != 1:
        raise ValueError(f"files below {path} have separators {found}")
    return found[0]


def layouts(spark: SparkSession, path: str, columns, sep: str | None = None, *, aliases=None, required=None) -> dict[tuple, list[str]]:
    """Files by layout: (separator, number of columns, place of each wanted column or None). Files whose headers differ in other
    columns alone, but have as many of them, share a layout."""
    aliases, required, out = aliases or {}, set(columns if required is None else required), {}
    for file, head in _headers(spark, path):
        mark = sep or separator_of(head)
        names = [header_name(x) for x in next(csv.reader([head], delimiter=mark), [])]
        places = []
        for c in columns:
            found = [names.index(n) for n in (header_name(x) for x in (c, *aliases.get(c, ()))) if n in names]
            if not found and c in required:
                raise ValueError(f"no column {c} in {file}")
            places.append(found[0] if found else None)
        out.setdefault((mark, len(names), tuple(places)), []).append(file)
    return out


def _as_path(uri: str) -> str:
    """A file's path for a reader, from the escaped form in which Spark reports it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def read_text_table(spark: SparkSession, path: str, columns, sep: str | None = None, *, aliases=None, required=None) -> DataFrame:
    """Delimited files with a header each, every column as text, and ``_file``.

    Columns are found by name in the header of their own file, so files of one call may differ in order, in further columns (any number) and
    (with ``sep=None``) in the separator. ``aliases`` maps a column to other names it may have. A file without one of the ``required`` columns
    (all by default) is an error that names it; other missing columns are null. Lines are records: quoted line breaks are not supported.

    Headers make a catalogue of layouts; each layout is one scan that parses the wanted columns alone."""
    out = None
    for (mark, width, places), files in sorted(layouts(spark, path, columns, sep, aliases=aliases, required=required).items(), key=str):
        schema = ", ".join(f"c{i} STRING" for i in range(width))
        rows = spark.read.schema(schema).csv([_as_path(f) for f in files], sep=mark, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        cells = [F.lit(None).cast("string") if at is None else F.col(f"c{at}") for at in places]
        part = rows.select(*[x.alias(c) for c, x in zip(columns, cells)], F.col("_metadata.file_path").alias("_file"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*columns, "_file")))
    return out


def _name_parts(path, group: int) -> Column:
    """Series name (1) and frequency word (2) of the last ``name[_frequency].csv`` of a path; parts written by Spark lie below such a name."""
    words = "|".join(sorted(FREQUENCIES, key=len, reverse=True))
    return F.regexp_extract(as_col(path), rf"(?i)([^/=]+?)(?:_({words}))?\.csv(?:/part-[^/]*)?$", group)


def symbol_from_path(path) -> Column:
    """Series name from file names such as ``SPX_30min.csv``, ``BRK.B_daily.csv`` or ``AAPL.csv``, percent-escapes decoded."""
    return F.upper(F.url_decode(F.replace(_name_parts(path, 1), F.lit("+"), F.lit("%2B"))))


def minutes_from_path(path) -> Column:
    """Bar minutes from the file name; daily without a frequency."""
    word = F.lower(_name_parts(path, 2))
    out = F.when(word == "", 1440)
    for name, minutes in FREQUENCIES.items():
        out = out.when(word == name, minutes)
    return out


def read_bars(spark: SparkSession, path: str, *, sep: str | None = None, columns=BAR_COLUMNS, src_tz: str | None = None,
              offset_minutes: int = 0) -> DataFrame:
    """A1: many per-series CSV files as one long bar table.

    Columns are found by name in each file (``columns`` may hold the bar columns in any order); those beyond OHLCV are kept in ``extras``.
    Time and the four prices must be there; volume and extras may be missing in some files.
    """
    raw = read_text_table(spark, path, columns, sep, aliases=BAR_ALIASES, required=[c for c in columns if c in ("time", "open", "high", "low", "close")])
    raw = raw.withColumns({"symbol": symbol_from_path("_file"), "freq_min": minutes_from_path("_file")}).drop("_file")
    typed = normalize_numeric(normalize_time(raw, "time", src_tz=src_tz, offset_minutes=offset_minutes),
                              [c for c in columns if c != "time"])
    extras = [c for c in columns if c not in BAR_COLUMNS]
    have = [c if c in columns else F.lit(None).cast("double").alias(c) for c in PRICE_COLUMNS]
    out = typed.select("symbol", "freq_min", "ts", F.to_date("ts").alias("d"), minute_of_day("ts").alias("minute_of_day"),
                       *have, *([F.create_map(*[x for c in extras for x in (F.lit(slug_name(c)), F.col(c))]).alias("extras")]
                                if extras else []))
    return out


def slug_name(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name.strip().lower()).strip("_")


def read_calendar(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A4: the economic calendar, several rows per day."""
    names = ["Date", "Event", "Impact", "Actual", "Estimate", "Options Expiration", "Date earnings top2 companies",
             "Low Activity Period"]
    raw = normalize_time(read_text_table(spark, path, names, sep, required=["Date", "Event"]), "Date")
    return raw.select(F.to_date("ts").alias("d"), F.col("Event").alias("event"), F.lower(F.trim("Impact")).alias("impact"),
                      number("Actual").alias("actual"), number("Estimate").alias("estimate"),
                      F.col("Options Expiration").alias("opex"),
                      F.col("Date earnings top2 companies").alias("earnings_top2"),
                      F.col("Low Activity Period").alias("low_activity"))


def read_earnings(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A4: per-ticker earnings dates (``date;quarter;type``)."""
    raw = read_text_table(spark, path, ["date", "quarter", "type"], sep, required=["date"])
    raw = raw.withColumn("symbol", F.regexp_replace(symbol_from_path("_file"), "_EARNINGS$", ""))
    return normalize_time(raw, "date").select("symbol", F.to_date("ts").alias("d"), "quarter", "type")


def read_earnings_events(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A4: earnings with report timing and surprise."""
    raw = read_text_table(spark, path, ["date", "timing", "eps_actual", "eps_estimated", "surprise_pct"], sep, required=["date"])
    raw = raw.withColumn("symbol", symbol_from_path("_file"))
    out = normalize_numeric(normalize_time(raw, "date"), ["eps_actual", "eps_estimated", "surprise_pct"])
    return out.select("symbol", F.to_date("ts").alias("d"), F.lower(F.trim("timing")).alias("timing"), "eps_actual",
                      "eps_estimated", "surprise_pct")


def read_chains(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A4: option-chain snapshots, one file per level; the chain id is the file name, its number the level."""
    names = ["Strike", "CallBid", "CallAsk", "CallDelta", "PutBid", "PutAsk", "PutDelta"]
    raw = read_text_table(spark, path, names, sep).withColumn("chain_id", symbol_from_path("_file"))
    level = F.regexp_replace(F.regexp_extract("chain_id", r"(\d+(?:[._]\d+)?)", 1), "_", ".").try_cast("double")
    out = normalize_numeric(raw, names)
    return out.select("chain_id", level.alias("vix_level"), F.col("Strike").alias("strike"),
                      F.col("CallBid").alias("call_bid"), F.col("CallAsk").alias("call_ask"),
                      F.col("CallDelta").alias("call_delta"), F.col("PutBid").alias("put_bid"),
                      F.col("PutAsk").alias("put_ask"), F.col("PutDelta").alias("put_delta"))


def previous_in_order(df: DataFrame, value: str, *, by, order: str, chunk: Column, name: str) -> DataFrame:
    """``value`` of the previous row by ``order`` within ``by``, computed per (by, chunk) group.

    ``chunk`` is monotone in ``order`` and cuts a hot key into bounded pieces; the last value of the
    preceding chunk is handed over through a per-chunk summary row.
    """
    by = keys(by)
    rows = df.withColumns({"_chunk": chunk, "_carry": F.lit(1)})
    summary = rows.groupBy(*by, "_chunk").agg(F.max_by(value, order).alias("_last"))
    w = Window.partitionBy(*by).orderBy("_chunk")
    handed = summary.select(*by, "_chunk", F.lag("_last").over(w).alias(value), F.lit(0).alias("_carry"))
    both = rows.unionByName(handed, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_chunk").orderBy("_carry", order)
    return both.withColumn(name, F.lag(value).over(inside)).filter("_carry = 1").drop("_chunk", "_carry")


def profile_series(df: DataFrame, *, symbol="symbol", ts="ts", order: str | None = None, order_chunk: int = 1000000) -> DataFrame:
    """A5: quality per series: rows, parse rate, duplicate and unsorted timestamps, dominant bar length,
    OHLC-complete and OHLC-inconsistent rows.

    ``order`` is the ingestion order (needed for the sortedness count). Gaps are taken per symbol and
    day, so a symbol with a third of all rows is spread over its days.
    """
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    complete = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    bad = complete & ((h < F.greatest(o, c, l)) | (l > F.least(o, c, h)))
    counts = df.groupBy(symbol).agg(
        F.count(F.lit(1)).alias("rows"), (F.count(ts) / F.count(F.lit(1))).alias("time_parse_rate"),
        count_where(complete).alias("ohlc_complete_rows"), count_where(bad).alias("ohlc_bad_rows"))
    stamps = df.filter(F.col(ts).isNotNull()).groupBy(symbol, ts).agg(F.count(F.lit(1)).alias("_n"))
    dup = stamps.groupBy(symbol).agg(F.sum(F.col("_n") - 1).alias("duplicate_timestamps"))
    gaps = previous_in_order(stamps, ts, by=symbol, order=ts, chunk=F.to_date(ts), name="_prev")
    gaps = gaps.select(symbol, F.round(minutes_between(ts, "_prev"), 6).alias("_gap")).filter("_gap > 0")
    common = (gaps.groupBy(symbol, "_gap").agg(F.count(F.lit(1)).alias("_n")).groupBy(symbol)
              .agg(F.max_by("_gap", F.struct(F.col("_n"), -F.col("_gap"))).alias("dominant_minutes")))
    out = counts.join(dup, symbol, "left").join(common, symbol, "left")
    if order is not None:
        seen = previous_in_order(df.select(symbol, order, ts), ts, by=symbol, order=order,
                                 chunk=F.floor(F.col(order) / order_chunk), name="_prev")
        out = out.join(seen.groupBy(symbol).agg(count_where(F.col(ts) < F.col("_prev")).alias("unsorted_rows")), symbol, "left")
        out = out.withColumn("sorted_ok", F.col("unsorted_rows") == 0)
    return out


def series_catalog(df: DataFrame, *, symbol="symbol", d="d", view: str | None = None) -> DataFrame:
    """Rows, first and last day and non-empty columns per series. ``view`` also registers the
    table for ``spark.sql``."""
    if view is not None:
        df.createOrReplaceTempView(view)
    values = [c for c in df.columns if c not in (symbol, d)]
    filled = F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in values]))
    return df.groupBy(symbol).agg(F.count(F.lit(1)).alias("rows"), F.min(d).alias("first_d"), F.max(d).alias("last_d"),
                                  F.count_distinct(d).alias("days"), filled.alias("columns"))


def is_single_stock(name) -> Column:
    """A name of one to five letters without any market word."""
    base = F.regexp_replace(F.lower(as_col(name)), "_(daily|30min|5min|1min|1hour|4hour|weekly|monthly).*$", "")
    base = F.regexp_replace(base, r"[_\s,]+", "")
    return base.rlike("^[a-z]{1,5}$") & ~any_of([base.contains(w) for w in MARKET_WORDS])


def select_market_series(catalog: DataFrame, exclude: str = "", min_rows: int = 50, *, symbol="symbol") -> DataFrame:
    """The market-context series of a catalog (no single stocks, side tables, intraday files or the
    excluded name), with the column they are compared by."""
    name = F.lower(symbol)
    keep = [~name.contains(w) for w in SIDE_TABLE_WORDS + INTRADAY_WORDS] + [~is_single_stock(symbol), F.col("rows") >= min_rows]
    if exclude:
        keep.append(~name.contains(exclude.lower()))
    compared = F.when(any_of([name.contains(w) for w in CHANGE_WORDS]), "var_pct").otherwise("close")
    return catalog.filter(all_of(keep)).withColumn("compared_by", compared)


def write_signals(df: DataFrame, path: str, key=None, mode: str = "overwrite") -> None:
    """Persist signals, rules or scan snapshots as parquet, partitioned by ``key`` if given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys(key)) if key else writer).parquet(path)
