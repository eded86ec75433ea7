"""Names over wide and long families, masks of every type, and completion of sparse features."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from tapestudy.operators import features as H
from tapestudy.operators import filters as B


def test_assembled_names_are_unique(spark):
    wide = spark.createDataFrame([("p", dt.date(2024, 1, 2), 1.0, 2.0)], "panel string, d date, spx double, other double")
    long = spark.createDataFrame([("p", dt.date(2024, 1, 2), "spx", 9.0), ("p", dt.date(2024, 1, 2), "refuge_gold_dxy_ratio_pct252", 5.0), ("p", dt.date(2024, 1, 2), "own", 3.0), ("p", dt.date(2024, 1, 2), "vts_composite_stress", 4.0)],
                                 "panel string, d date, feature string, value double")
    later = spark.createDataFrame([("p", dt.date(2024, 1, 2), 7.0, 8.0)], "panel string, d date, own double, new double")
    rows = lambda fams: sorted((r.feature, r.value) for r in H.assemble_features(fams).collect())
    assert rows([wide, long, later]) == [("new", 8.0), ("other", 2.0), ("own", 3.0), ("spx", 1.0), ("vts_composite_stress", 4.0)]
    assert rows([long, wide, later]) == [("new", 8.0), ("other", 2.0), ("own", 3.0), ("spx", 9.0), ("vts_composite_stress", 4.0)]
    assert {r.feature: r.p for r in long.select("feature", H._long_priority("feature").alias("p")).collect()} == {f: H.priority_of(f) for f in ("spx", "own", "refuge_gold_dxy_ratio_pct252", "vts_composite_stress")}
    names = [*H.HIGH_PRIORITY, *H.priorities(), "div_other", "cfm_vix_x", "plain"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    assert all(r.p == H.priority_of(r.n) for r in frame.select("n", H._long_priority("n").alias("p")).collect())


def test_open_days_hide_every_type(spark):
    day = dt.date(2024, 1, 2)
    df = spark.createDataFrame([("A", d, 1.0, 2.0, "red", dt.datetime(2024, 1, 2, 15), d) for d in (dt.date(2024, 1, 1), day)],
                               "symbol string, d date, open double, close double, color string, high_at timestamp_ntz, settled date")
    out = {r.d: r for r in B.ex_ante_mask_daily(df, day.isoformat()).collect()}
    assert out[day].open == 1.0 and out[day].symbol == "A" and not out[day].full_candle
    assert (out[day].close, out[day].color, out[day].high_at, out[day].settled) == (None,) * 4
    assert out[dt.date(2024, 1, 1)].color == "red"
    bars = df.withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-02 09:30:00")))
    row = B.ex_ante_mask_intraday(bars.filter(F.col("d") == day), "2024-01-02 09:40:00", 30).first()
    assert (row.open, row.color, row.high_at) == (1.0, None, None)


def test_completion_equals_brute_force(spark):
    r = random.Random(1)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(200)]
    data = {f: {d: round(r.random(), 4) for d in days if r.random() > gap} for f, gap in (("a", 0.0), ("b", 0.2), ("c", 0.6), ("late", 0.0), ("b2", 0.01))}
    data["late"] = {d: v for d, v in data["late"].items() if d >= days[150]}
    data["a"] |= {d: 0.5 for d in days}
    df = spark.createDataFrame([(f, d, v) for f, vs in data.items() for d, v in vs.items()] + [("b", days[3], None)] * (days[3] not in data["b"]), "feature string, d date, value double")
    want = {}
    for f, vs in data.items():
        if 1 - len(vs) / 200 <= 0.4:
            median = statistics.median(v for d, v in vs.items() if d in days[:140])
            want |= {(f, d): vs.get(d, median) for d in days}
    got = {(x.feature, x.d): x.value for x in H.drop_sparse_and_impute(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert H.drop_sparse_and_impute(df.limit(0)).count() == 0
