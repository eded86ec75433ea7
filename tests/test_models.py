import numpy as np
import pandas as pd
import pytest

from tapestudy.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 160
    cat = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"d": pd.bdate_range("2023-01-02", periods=n).date, "good": cat + rng.normal(0, 0.2, n), "noise": rng.normal(0, 1, n)})
    pdf["twin"] = pdf.good * 2 + 0.001 * rng.normal(0, 1, n)
    pdf["y_cat"], pdf["y_amp"] = cat, cat * 0.3 + rng.random(n) * 0.1
    return spark.createDataFrame(pdf, "d date, good double, noise double, twin double, y_cat int, y_amp double")


def test_folds_are_ordered():
    folds = M.time_folds(100, 5)
    assert folds[-1][1] == 100 and all(a < b for a, b in folds) and [a for a, _ in folds][1:] == [b for _, b in folds][:-1]


def test_split_is_chronological(rows):
    out = M.chrono_split(rows).select("d", "in_sample").orderBy("d").collect()
    assert [r.in_sample for r in out] == [True] * 112 + [False] * 48


def test_models_learn_and_score_the_newest_row(rows):
    fitted = M.train_amplitude(rows, ["good", "noise"], trees=10, depth=3, learners=["random_forest"])
    m = fitted.metrics.first()
    assert m.n_train == 112 and m.n_test == 48 and m.acc_oos > 80 and m.mae < 0.15 and m.is_best
    weight = {r.feature: r.importance for r in fitted.importances.collect()}
    assert weight["good"] > weight["noise"]
    latest = M.score_latest(fitted, rows).collect()
    assert len(latest) == 1 and str(latest[0].d) == str(max(r.d for r in rows.select("d").collect())) and abs(sum(latest[0].probabilities) - 1) < 1e-9


def test_redundant_features_are_dropped(rows):
    chosen = M.select_features(rows, ["good", "noise", "twin"], 3, folds=2, trees=8)
    assert "noise" in chosen and len({"good", "twin"} & set(chosen)) == 1
