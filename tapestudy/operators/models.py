"""Chronologically split Spark ML models (K1-K6).

Rows are sessions with a date, numeric feature columns and y_cat (0, 1, 2) / y_amp. Training is distributed by Spark ML; only
metrics, importances of named features and one correlation matrix of candidate features come back to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pearson
from ..functions.windows import keys
from .features import session_split

SEED = 42


def chrono_split(df: DataFrame, share: float = 0.7, *, d="d") -> DataFrame:
    """K1: adds session_no, n_sessions and ``in_sample`` (the first ``share`` of the distinct dates); never a random split."""
    return df.join(session_split(df, share, d=d), [d])


def in_sample_medians(df: DataFrame, names) -> dict[str, float]:
    """The value that stands in for a missing one: the median over the in-sample rows, or 0 if that is missing too. One row comes back."""
    row = df.filter("in_sample").agg(*[F.percentile(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), 0.5).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return {c: row[i] if row[i] is not None else 0.0 for i, c in enumerate(names)}


def assemble(df: DataFrame, names, fill: dict[str, float]) -> DataFrame:
    """The feature vector; missing values take those of ``fill``, no row is left out."""
    filled = df.withColumns({c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(float(fill[c]))) for c in names})
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error").transform(filled)


def last_session(rows: DataFrame) -> int:
    """The number of sessions: bounds of folds count dates, however many rows a date has."""
    return rows.agg(F.max("session_no").alias("m")).first()["m"] or 0


def time_folds(n: int, k: int = 5):
    """Bounds (train end, test end), in sessions, of expanding folds with equally long tests at the end."""
    size = n // (k + 1)
    first = n - k * size
    return [(first + i * size, first + (i + 1) * size) for i in range(k)] if size else []


def _accuracy(scored: DataFrame, label: str = "y_cat") -> float | None:
    return scored.agg((F.avg((F.col("prediction") == F.col(label)).cast("double")) * 100.0).alias("a")).first()["a"]


def _learners(trees: int, depth: int):
    base = GBTClassifier(labelCol="y_cat", maxIter=trees // 2, maxDepth=depth, stepSize=0.1, seed=SEED)
    return {
        "random_forest": (RandomForestClassifier(labelCol="y_cat", numTrees=trees, maxDepth=depth + 1, seed=SEED),
                          RandomForestRegressor(labelCol="y_amp", numTrees=trees, maxDepth=depth + 1, seed=SEED)),
        "boosted_one_vs_rest": (OneVsRest(classifier=base, labelCol="y_cat"), GBTRegressor(labelCol="y_amp", maxIter=trees // 2, maxDepth=depth, stepSize=0.1, seed=SEED)),
    }


def _importances(model, names):
    """Feature importances of a tree model; those of one-vs-rest are averaged over its models."""
    parts = model.models if hasattr(model, "models") else [model]
    total = sum(p.featureImportances.toArray() for p in parts) / len(parts)
    return list(zip(names, total.tolist()))


@dataclass
class AmplitudeModels:
    """Fitted models by name with one metrics row each; ``best`` has the highest out-of-sample accuracy."""
    names: list
    fill: dict = field(default_factory=dict)
    classifiers: dict = field(default_factory=dict)
    regressors: dict = field(default_factory=dict)
    metrics: DataFrame | None = None
    importances: DataFrame | None = None
    distributions: DataFrame | None = None
    best: str | None = None


def train_amplitude(df: DataFrame, names, share: float = 0.7, trees: int = 50, depth: int = 4, folds: int = 0, min_is: int = 30, min_oos: int = 10, reliable: float = 55.0,
                    learners=None, *, d="d") -> AmplitudeModels:
    """K2: a three-class classifier and an amplitude regressor per learner: in- and out-of-sample accuracy, mean absolute error, importances and class
    distributions, with optional time-fold cross-validation."""
    spark = df.sparkSession
    split = chrono_split(df, share, d=d)
    fill = in_sample_medians(split, names)
    data = assemble(split, names, fill).select(d, "session_no", "in_sample", "features", F.col("y_cat").cast("double").alias("y_cat"), F.col("y_amp").cast("double").alias("y_amp"))
    data = data.persist()
    train, test = data.filter("in_sample"), data.filter("NOT in_sample")
    n_train, n_test = train.count(), test.count()
    if n_train < min_is or n_test < min_oos:
        raise ValueError(f"not enough sessions: {n_train} in sample, {n_test} out of sample")
    out = AmplitudeModels(list(names), fill)
    metrics, weights, dist = [], [], None
    for name, (clf, reg) in _learners(trees, depth).items():
        if learners is not None and name not in learners:
            continue
        model, amp = clf.fit(train), reg.fit(train)
        scored = model.transform(test)
        acc_is, acc_oos = _accuracy(model.transform(train)), _accuracy(scored)
        mae = amp.transform(test).agg(F.avg(F.abs(F.col("prediction") - F.col("y_amp"))).alias("m")).first()["m"]
        cv = []
        for end, stop in time_folds(last_session(train), folds) if folds else []:
            fold = clf.fit(train.filter(F.col("session_no") <= end))
            cv.append(_accuracy(fold.transform(train.filter((F.col("session_no") > end) & (F.col("session_no") <= stop)))))
        cv = [c for c in cv if c is not None]
        mean = sum(cv) / len(cv) if cv else None
        std = (sum((c - mean) ** 2 for c in cv) / len(cv)) ** 0.5 if cv else None
        metrics.append((name, acc_is, acc_oos, mae, n_train, n_test, acc_oos >= reliable, mean, std))
        weights += [(name, f, w) for f, w in _importances(model, names)]
        part = scored.groupBy(F.lit(name).alias("model"), F.col("prediction").cast("int").alias("category")).agg(F.count(F.lit(1)).alias("n"))
        dist = part if dist is None else dist.unionByName(part)
        out.classifiers[name], out.regressors[name] = model, amp
    real = test.groupBy(F.lit("observed").alias("model"), F.col("y_cat").cast("int").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    out.best = max(metrics, key=lambda m: (m[2], m[0]))[0]
    out.metrics = spark.createDataFrame([(*m, m[0] == out.best) for m in metrics], "model string, acc_is double, acc_oos double, mae double, n_train long, n_test long, is_reliable boolean, cv_mean double, cv_std double, is_best boolean")
    out.importances = spark.createDataFrame(weights, "model string, feature string, importance double")
    kinds = dist.unionByName(real).collect()  # one row per model and class
    out.distributions = spark.createDataFrame(kinds, "model string, category int, n long")
    data.unpersist()
    return out


def score_latest(models: AmplitudeModels, df: DataFrame, model: str | None = None, *, d="d") -> DataFrame:
    """K3: class, amplitude and class probabilities of the newest row."""
    name = model or models.best
    newest = df.agg(F.max(d).alias("m")).scalar()
    row = assemble(df.filter(F.col(d) == newest), models.names, models.fill)
    out = models.classifiers[name].transform(row).withColumn("category", F.col("prediction").cast("int"))
    prob = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
    out = out.select(d, "features", "category", prob.alias("probabilities"))
    return models.regressors[name].transform(out).select(d, "category", F.col("prediction").alias("amplitude"), "probabilities")


def select_features(df: DataFrame, names, n_top: int | None = None, folds: int = 5, max_corr: float = 0.95, share: float = 0.7, trees: int = 30, depth: int = 3, min_train: int = 30, *, d="d") -> list[str]:
    """K4: the features of highest mean importance over expanding time folds of the in-sample rows, without the less important one of every pair
    correlated beyond ``max_corr``; ``n_top``: only the first ones."""
    names = list(names)
    split = chrono_split(df, share, d=d).filter("in_sample")
    fill = in_sample_medians(split, names)
    rows = assemble(split, names, fill).select("session_no", "features", F.col("y_cat").cast("double").alias("y_cat")).persist()
    n = last_session(rows)
    clf = RandomForestClassifier(labelCol="y_cat", numTrees=trees, maxDepth=depth, seed=SEED)
    ends = [e for e, _ in time_folds(n, folds) if e >= min_train] or [n]
    total = dict.fromkeys(names, 0.0)
    for end in ends:
        for f, w in _importances(clf.fit(rows.filter(F.col("session_no") <= end)), names):
            total[f] += w / len(ends)
    ranked = sorted(names, key=lambda f: (-total[f], f))
    rows.unpersist()
    vectors = assemble(split.select(*ranked), ranked, fill)
    corr = Correlation.corr(vectors, "features").first()[0].toArray()
    dropped = set()
    for i, a in enumerate(ranked):
        if a in dropped:
            continue
        dropped |= {b for j, b in enumerate(ranked) if j > i and abs(corr[i][j]) > max_corr}
    return [f for f in ranked if f not in dropped][:n_top]


def top_features(df: DataFrame, names, n: int | None = None, share: float = 0.7, trees: int = 50, depth: int = 3, *, d="d") -> DataFrame:
    """K5: importance ranking on the in-sample rows for class 2 against the rest."""
    y = F.when(F.col("y_cat") == 2, 1.0).otherwise(0.0).alias("label")
    split = chrono_split(df, share, d=d).filter("in_sample")
    rows = assemble(split, names, in_sample_medians(split, names)).select("features", y)
    model = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(rows)
    ranked = sorted(_importances(model, names), key=lambda x: (-x[1], x[0]))[:n]
    return df.sparkSession.createDataFrame([(f, float(w), i) for i, (f, w) in enumerate(ranked)], "feature string, importance double, position int")


def correlation_ranking(features: DataFrame, sessions: DataFrame, n: int | None = None, *, d="d", by=()) -> DataFrame:
    """K5 without a model: features by the size of their in-sample correlation with y, from long features and ``rules.rule_sessions``."""
    group = keys(by) if by else []
    rows = features.join(sessions.filter("in_sample").select(*group, d, F.col("y").cast("double").alias("y")), [d])
    out = rows.groupBy(*group, "feature").agg(pearson("value", "y").alias("corr"))
    out = out.withColumn("abs_corr", F.abs("corr")).orderBy(F.col("abs_corr").desc_nulls_last(), "feature")
    return out if n is None else out.limit(n)


def binary_strong_classifier(df: DataFrame, names, share: float = 0.7, iterations: int = 30, depth: int = 3, at: float = 0.70, folds: int = 5, *, d="d"):
    """K6: probability of class 2 with class weights and isotonic calibration. Returns (curve, folds): out-of-sample precision, number and signals per quarter at
    thresholds .40 to .95, and the precision of each time fold at ``at``.

    The calibration is fitted on predictions for in-sample rows the base model of an earlier fold has not seen.
    """
    spark = df.sparkSession
    split = chrono_split(df, share, d=d)
    rows = assemble(split, names, in_sample_medians(split, names))
    rows = rows.select("session_no", "n_sessions", "in_sample", "features", F.when(F.col("y_cat") == 2, 1.0).otherwise(0.0).alias("label")).persist()
    train, test = rows.filter("in_sample"), rows.filter("NOT in_sample")
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    weight = (stats["n"] - stats["p"]) / max(stats["p"], 1.0)
    weighted = lambda x: x.withColumn("w", F.when(F.col("label") == 1.0, weight).otherwise(1.0))
    gbt = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=0.05, weightCol="w", subsamplingRate=0.8, seed=SEED)
    p1 = vector_to_array("probability")[1]
    unseen, fold_rows = None, []
    for i, (end, stop) in enumerate(time_folds(last_session(train), folds)):
        model = gbt.fit(weighted(train.filter(F.col("session_no") <= end)))
        scored = model.transform(train.filter((F.col("session_no") > end) & (F.col("session_no") <= stop))).select(p1.alias("p"), "label")
        unseen = scored if unseen is None else unseen.unionByName(scored)
        hit = scored.filter(F.col("p") >= at).agg(F.count(F.lit(1)).alias("n"), (F.avg("label") * 100.0).alias("precision")).first()
        fold_rows.append((i + 1, hit["n"], hit["precision"]))
    calibrated = IsotonicRegression(featuresCol="p", labelCol="label").fit(unseen)
    scored = calibrated.transform(gbt.fit(weighted(train)).transform(test).select(p1.alias("p"), "label")).withColumnRenamed("prediction", "probability")
    levels = [round(0.40 + 0.05 * i, 2) for i in range(12)]
    aggs = [F.count(F.lit(1)).alias("n_test")]
    for i, t in enumerate(levels):
        on = F.col("probability") >= t
        aggs += [F.count_if(on).alias(f"n{i}"), F.avg(F.when(on, F.col("label") * 100.0)).alias(f"p{i}")]
    wide = scored.agg(*aggs)
    rows_ = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n_oos"), F.col(f"p{i}").alias("precision")) for i, t in enumerate(levels)])
    curve = wide.select("n_test", F.inline(rows_)).withColumn("per_quarter", F.col("n_oos") / F.greatest(F.col("n_test") / 63.0, F.lit(1.0))).drop("n_test")
    return curve, spark.createDataFrame(fold_rows, "fold int, n int, precision double")
