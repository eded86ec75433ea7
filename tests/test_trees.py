"""Grouped histogram trees against brute force on toy frames."""

import random

import pytest
from pyspark.sql import functions as F

from tapestudy.operators import trees as H
from tapestudy.operators.rules import materialize, rule_sessions

DAYS = 200


@pytest.fixture(scope="module")
def market(spark):
    """Three features; the class of symbol A follows f1, that of B follows f2, with some noise."""
    r = random.Random(3)
    x = {f"f{i}": [round(r.gauss(0, 1), 4) for _ in range(DAYS)] for i in range(3)}
    amp = {s: [round(abs(2 * (x[f][t] > 0.3) + r.gauss(0, 0.3)), 4) for t in range(DAYS)] for s, f in (("A", "f1"), ("B", "f2"))}
    features = spark.createDataFrame([(f, t, v) for f, vs in x.items() for t, v in enumerate(vs)], "feature string, t int, value double").selectExpr("feature", "date_add(DATE'2020-01-01', t) AS d", "value")
    targets = spark.createDataFrame([(s, t, amp[s][t]) for s in amp for t in range(DAYS)], "symbol string, t int, y_amp double").selectExpr("symbol", "date_add(DATE'2020-01-01', t) AS d", "y_amp")
    targets = targets.withColumn("y_cat", F.when(F.col("y_amp") >= 1.5, 2).when(F.col("y_amp") <= 0.2, 0).otherwise(1))
    sessions = materialize(rule_sessions(targets, F.col("y_cat") == 2, by=["symbol"]))
    return features, sessions, x, amp


def category(a):
    return 2 if a >= 1.5 else 0 if a <= 0.2 else 1


def quantile(values, p):
    at = (len(values) - 1) * p
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def test_stump_equals_brute_force(market):
    features, sessions, x, amp = market
    got = {r.symbol: r for r in H.stump(features, sessions).collect()}
    split = int(DAYS * 0.7)
    for s, a in amp.items():
        y, options = [category(v) for v in a[:split]], []
        square = lambda rows: sum(rows.count(k) ** 2 for k in range(3)) / len(rows)
        for f, vs in x.items():
            for p in range(10, 91, 10):
                t = quantile(sorted(vs[:split]), p / 100)
                low, high = [k for k, v in zip(y, vs) if v <= t], [k for k, v in zip(y, vs) if v > t]
                if len(low) >= 5 and len(high) >= 5:
                    options.append((-round(square(low) + square(high) - square(y), 9), f, p, len(low), len(high)))
        best = min(options)
        r = got[s]
        assert (r.feature, r.percentile, r.n_below, r.n_above) == best[1:] and abs(r.gain + best[0]) < 1e-6


def test_models_of_all_groups(market):
    features, sessions, *_ = market
    models = H.fit(features, sessions, ("class", "amount", "strong"), folds=2, options={"forest": {"trees": 6, "depth": 2, "share": 1.0}, "boosted": {"rounds": 4, "depth": 1, "rate": 0.5}})
    metrics = {(r.symbol, r.learner): r for r in H.amplitude_metrics(models).collect()}
    assert set(metrics) == {(s, n) for s in "AB" for n in ("forest", "boosted")}
    for r in metrics.values():
        assert (r.n_train, r.n_test) == (140, 60) and r.acc_oos >= 55 and r.mae < 0.9 and r.cv_mean is not None
    assert sorted(s for s, n in metrics if metrics[s, n].is_best) == ["A", "B"]
    newest = H.score_newest(models, H.amplitude_metrics(models)).collect()
    assert {r.symbol for r in newest} == {"A", "B"} and all(abs(sum(r.probabilities) - 1) < 1e-9 and r.amplitude is not None for r in newest)
    top = {r.symbol: r.feature for r in H.top_features(models, 1).collect()}
    assert top == {"A": "f1", "B": "f2"}
    chosen = H.select_features(models, features.unionByName(features.filter("feature = 'f1'").withColumn("feature", F.lit("g1"))), sessions).collect()
    assert {r.feature for r in chosen if r.symbol == "A"} == {"f0", "f1", "f2"}  # g1 repeats f1 and matters less
    curve, choice = H.strong_classifier(models)
    picked = {r.symbol: r for r in choice.collect() if r.is_best}
    assert set(picked) == {"A", "B"}
    for s, r in picked.items():
        assert all((o.precision or -1) <= (r.precision or -1) for o in choice.collect() if o.symbol == s)
    rows = curve.collect()
    assert len(rows) == 2 * 2 * 12 and all(a.n_oos >= 0 for a in rows)


def test_folds_count_sessions(market):
    _, sessions, *_ = market
    got = {(r.symbol, r.fold): (r.a, r.b) for r in H.fold_sessions(sessions, 3, by=["symbol"]).groupBy("symbol", "fold").agg(F.count_if("train").alias("a"), F.count_if("test").alias("b")).collect()}
    assert got == {(s, f): v for s in "AB" for f, v in {0: (140, 60), 1: (35, 35), 2: (70, 35), 3: (105, 35)}.items()}
