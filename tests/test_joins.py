import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestudy.operators import filters as P
from tapestudy.operators import joins as J


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    # one key holds most of the rows and repeats times
    left = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 400, p=[0.8, 0.1, 0.1]), "i": range(400), "ts": [base + pd.Timedelta(minutes=int(x)) for x in rng.integers(0, 4000, 400)]})
    right = pd.DataFrame({"k": rng.choice(["hot", "a", "c"], 120), "ts": [base + pd.Timedelta(minutes=int(x)) for x in rng.integers(300, 3600, 120)]}).drop_duplicates(["k", "ts"])
    right["v"] = np.arange(len(right), dtype=float)
    make = lambda p, s: spark.createDataFrame(p, s)
    return make(left, "k string, i int, ts timestamp_ntz"), make(right, "k string, ts timestamp_ntz, v double"), left, right


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 45])
def test_asof_matches_pandas(sides, direction, exact, tolerance):
    left, right, pl, pr = sides
    if direction == "nearest" and not exact:
        pytest.skip("an exact match is always the nearest")
    got = J.asof_join(left, right, on="ts", by="k", direction=direction, allow_exact=exact, tolerance=tolerance, chunk="day", right_unique=True).toPandas().sort_values("i")
    want = pd.merge_asof(pl.sort_values("ts"), pr.sort_values("ts"), on="ts", by="k", direction=direction, allow_exact_matches=exact,
                         tolerance=None if tolerance is None else pd.Timedelta(minutes=tolerance)).sort_values("i")
    assert len(got) == len(pl)
    assert np.array_equal(got.v.to_numpy(), want.v.to_numpy(), equal_nan=True)


def test_asof_chunks_do_not_matter(sides):
    left, right, _, _ = sides
    runs = [J.asof_join(left, right, on="ts", by="k", chunk=c).orderBy("i").collect() for c in ("year", "day", "hour")]
    assert runs[0] == runs[1] == runs[2]


def test_nearest_tie_rule(spark):
    left = spark.createDataFrame([("2024-01-10",)], "d string").select(F.to_date("d").alias("d"))
    right = spark.createDataFrame([("2024-01-09", 1.0), ("2024-01-11", 2.0)], "d string, v double").withColumn("d", F.to_date("d"))
    pick = lambda tie: J.asof_join(left, right, on="d", direction="nearest", tie=tie).first()["v"]
    assert (pick("earlier"), pick("later")) == (1.0, 2.0)
    near = J.spread_nearest(right.withColumn("series", F.lit("s")), 2, value="v")
    assert {str(r.d): r.v for r in near.collect()}["2024-01-10"] == 2.0


def test_event_to_session(spark):
    bars = spark.createDataFrame([("A", d) for d in ("2024-01-05", "2024-01-08", "2024-01-09")], "symbol string, d string").withColumn("d", F.to_date("d"))
    events = spark.createDataFrame([("A", "2024-01-05", "bmo"), ("A", "2024-01-05", "amc"), ("A", "2024-01-06", "bmo"), ("A", "2023-12-01", "amc"), ("A", "2024-01-09", "amc")],
                                   "symbol string, d string, timing string").withColumn("d", F.to_date("d"))
    got = {(str(r.d), r.timing): None if r.session is None else str(r.session) for r in J.event_to_session(events, bars).collect()}
    assert got == {("2024-01-05", "bmo"): "2024-01-05", ("2024-01-05", "amc"): "2024-01-08", ("2024-01-06", "bmo"): "2024-01-08", ("2023-12-01", "amc"): "2024-01-05", ("2024-01-09", "amc"): None}


def test_ffill_to_index_keeps_only_index_days(spark):
    s = spark.createDataFrame([("x", "2024-01-01", 1.0), ("x", "2024-01-04", None), ("x", "2024-01-06", 3.0)], "series string, d string, value double").withColumn("d", F.to_date("d"))
    idx = spark.createDataFrame([(x,) for x in ("2023-12-31", "2024-01-02", "2024-01-05", "2024-01-08")], "d string").select(F.to_date("d").alias("d"))
    got = {str(r.d): r.value for r in J.ffill_to_index(s, idx).collect()}
    assert got == {"2024-01-02": 1.0, "2024-01-05": None, "2024-01-08": 3.0}


def test_boolean_tree_treats_null_as_false(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, c boolean")
    assert [r.i for r in P.boolean_filter(df, ("not", "c")).orderBy("i").collect()] == [1, 3]


def test_ex_ante_mask_hides_what_is_not_known(spark):
    df = spark.createDataFrame([("09:30", 1.0, 5.0), ("10:00", 2.0, 6.0), ("10:30", 3.0, 7.0)], "t string, open double, close double").withColumn(
        "ts", F.concat(F.lit("2024-01-02 "), "t", F.lit(":00")).cast("timestamp_ntz"))
    at = lambda when, mode="generic": [(r.t, r.open, r.close) for r in P.ex_ante_mask_intraday(df, when, 30, mode, keep=(*P.KNOWN_AT_OPEN, "t")).orderBy("ts").collect()]
    assert P.ex_ante_mask_intraday(df, "2024-01-02 10:15:00", 30).orderBy("ts").collect()[1].t is None  # a text that is not named as known
    assert at("2024-01-02 10:15:00") == [("09:30", 1.0, 5.0), ("10:00", 2.0, None)]
    assert at("2024-01-02 10:30:00") == [("09:30", 1.0, 5.0), ("10:00", 2.0, 6.0), ("10:30", 3.0, None)]
    assert at("2024-01-02 10:30:00", "before_open") == [("09:30", 1.0, 5.0), ("10:00", 2.0, 6.0)]


def test_exclusion_window_is_in_calendar_days(toy):
    df, pdf = toy
    event = df.sparkSession.createDataFrame([("A", pdf.d[40])], "symbol string, d date")
    left = P.exclude_event_window(df, event)
    gone = sum(abs((x - pdf.d[40]).days) <= 5 for x in pdf[pdf.symbol == "A"].d)
    assert left.count() == len(pdf) - gone
