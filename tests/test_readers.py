import pytest
from pyspark.sql import functions as F

from tapestudy.sources import readers as R


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_numbers_with_commas_blanks_and_junk(spark):
    df = spark.createDataFrame([(" 1 234,5",), ("1 234,5",), ("n/a",), ("",), (None,), ("NaN",), ("-3.25",)], "x string")
    assert [r.x for r in R.normalize_numeric(df, ["x"]).collect()] == [1234.5, 1234.5, None, None, None, None, -3.25]
    mixed = spark.createDataFrame([("1.234,5",), ("1,234.5",), ("7,5",)], "x string")
    assert [r.x for r in R.normalize_numeric(mixed, ["x"], True).collect()] == [1234.5, 1234.5, 7.5]


def test_times_across_clock_changes(spark):
    texts = ["2024-03-15 15:30:00", "2024-07-01 15:30:00", "2024-03-31 02:30:00", "2024-10-27 02:30:00", "2024-10-27 03:30:00", "junk"]
    df = spark.createDataFrame([(t,) for t in texts], "time string")
    got = {r.time: str(r.ts) for r in R.normalize_time(df, src_tz="Europe/Paris").collect()}
    # two weeks in March differ by five hours; missing and doubled local times are dropped
    assert got == {texts[0]: "2024-03-15 10:30:00", texts[1]: "2024-07-01 09:30:00", texts[4]: "2024-10-26 22:30:00"}
    shifted = R.normalize_time(df.limit(1), offset_minutes=90).first()
    assert str(shifted.ts) == "2024-03-15 17:00:00"


def test_read_bars_from_files(spark, tmp_path):
    write(tmp_path / "SPX_30min.csv", "time;open;high;low;close;volume\n2024-01-02 10:00:00;1,5;2;1;1,75;10\nbad;1;1;1;1;1\n")
    write(tmp_path / "AAPL.csv", "time;open;high;low;close;volume\n2024-01-02;10;11;9;10,5;\n")
    got = {r.symbol: (r.freq_min, str(r.d), r.minute_of_day, r.open, r.close, r.volume) for r in R.read_bars(spark, str(tmp_path)).collect()}
    assert got == {"SPX": (30, "2024-01-02", 600, 1.5, 1.75, 10.0), "AAPL": (1440, "2024-01-02", 0, 10.0, 10.5, None)}
    assert R.detect_separator(spark, str(tmp_path)) == ";"


def test_side_tables(spark, tmp_path):
    for name in ("c", "e", "o"):
        (tmp_path / name).mkdir()
    write(tmp_path / "c" / "cal.csv", "Date;Event;Impact;Actual;Estimate;Options Expiration;Date earnings top2 companies;Low Activity Period\n2024-01-05;CPI;High;3,4;3,2;;AAPL;\n")
    write(tmp_path / "e" / "AAPL_earnings.csv", "date;quarter;type\n2024-02-01;Q1-2024;earnings\n")
    write(tmp_path / "o" / "chain_vix_17.5.csv", "Strike,CallBid,CallAsk,CallDelta,PutBid,PutAsk,PutDelta\n6500,10,11,0.5,9,10,-0.5\n")
    c = R.read_calendar(spark, str(tmp_path / "c")).first()
    assert (str(c.d), c.impact, c.actual, c.opex, c.earnings_top2) == ("2024-01-05", "high", 3.4, None, "AAPL")
    e = R.read_earnings(spark, str(tmp_path / "e")).first()
    assert (e.symbol, str(e.d), e.quarter) == ("AAPL", "2024-02-01", "Q1-2024")
    assert R.read_chains(spark, str(tmp_path / "o")).first().strike == 6500.0


def test_profile_counts_gaps_across_days(spark):
    ts = ["2024-01-01 23:00:00", "2024-01-02 00:00:00", "2024-01-02 01:00:00", "2024-01-02 01:00:00", "2024-01-02 00:30:00"]
    df = spark.createDataFrame([("A", i, t, 1.0, 2.0, 0.5, 3.0 if i == 0 else 1.5) for i, t in enumerate(ts)], "symbol string, seq long, t string, open double, high double, low double, close double")
    r = R.profile_series(df.withColumn("ts", F.col("t").cast("timestamp_ntz")), order="seq").first()
    assert (r.rows, r.duplicate_timestamps, r.dominant_minutes, r.unsorted_rows, r.sorted_ok, r.ohlc_bad_rows) == (5, 1, 30.0, 1, False, 1)


def test_market_series_selection(spark):
    names = ["VIX_daily", "AAPL", "SPX_30min", "option_chain_vix", "gold_daily", "tiny"]
    cat = spark.createDataFrame([(n, 10 if n == "tiny" else 100) for n in names], "symbol string, rows int")
    got = {r.symbol: r.compared_by for r in R.select_market_series(cat).collect()}
    assert got == {"VIX_daily": "close", "gold_daily": "var_pct"}


def test_layouts_of_any_width(spark, tmp_path):
    """Narrow and wide files, orders, separators, odd names and a missing column in one call."""
    wide = [f"x{i}" for i in range(200)]
    write(tmp_path / "WIDE.csv", ",".join(["time", "open", *wide, "high", "low", "close", "volume", "extra one"]) + "\n" + ",".join(["2024-01-02", "1", *["0"] * 200, "3", "0.5", "2", "70", "8"]) + "\n")
    write(tmp_path / "NARROW.csv", "\ufeffTime;Close; Open ;High;Low;Vol\n2024-01-02;2,5;1,5;3,5;1;\n\n")
    write(tmp_path / "a[1] b+c.csv", "date\topen\thigh\tlow\tclose\n2024-01-02\t1\t2\t0\t1\n")
    write(tmp_path / "EMPTY.csv", "")
    got = {r.symbol: (r.open, r.high, r.low, r.close, r.volume, r.extras) for r in R.read_bars(spark, str(tmp_path), columns=(*R.BAR_COLUMNS, "extra one")).collect()}
    assert got == {"WIDE": (1.0, 3.0, 0.5, 2.0, 70.0, {"extra_one": 8.0}), "NARROW": (1.5, 3.5, 1.0, 2.5, None, {"extra_one": None}), "A[1] B+C": (1.0, 2.0, 0.0, 1.0, None, {"extra_one": None})}
    assert len(R.layouts(spark, str(tmp_path), R.BAR_COLUMNS, aliases=R.BAR_ALIASES, required=["time"])) == 3
    write(tmp_path / "BAD.csv", "time;open;high;low\n2024-01-02;1;2;3\n")
    with pytest.raises(ValueError, match="no column close in .*BAD.csv"):
        R.read_bars(spark, str(tmp_path))
    only = tmp_path / "none"
    only.mkdir()
    write(only / "X.csv", "")
    assert R.read_bars(spark, str(only)).count() == 0
