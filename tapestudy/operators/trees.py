"""Histogram trees of many groups at once (K2-K6 by symbol).

All trees of all groups (symbol, fold, task) grow level by level together: one aggregate per level counts weights and target sums by
(group, tree, node, feature, bin), running sums over the few bins give every split, and the best split of every node is one row. No group passes
through a single task; the number of jobs depends on depth and rounds alone. Rows outside the training part have weight zero: they take no part in
any split, but move along and end in a leaf, so that predictions need no second pass.

Targets are arrays: class indicators (the gain is then that of the Gini index) or one amount (variance). Features are long and dense (see H21);
a missing value counts as the lowest bin. Equal gains (to nine digits) go to the first feature by name and the lowest bin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import keys
from ..sources.shared import materialize
from .rules import PERCENTILES, in_sample_thresholds

# Cumulative probabilities of the Poisson distribution with mean one, the weights of bootstrap draws.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


def fold_sessions(sessions: DataFrame, folds: int = 0, *, by=()) -> DataFrame:
    """``sessions`` (``rules.rule_sessions``) once per fold, with ``train`` and ``test``: fold 0 is in against out of sample; folds 1 to ``folds``
    are expanding parts of the in-sample sessions with equally long tests at the end, counted in sessions of each group."""
    n = F.max(F.when(F.col("in_sample"), F.col("session_no"))).over(Window.partitionBy(*keys(by)))
    rows = sessions.withColumn("_n", n).withColumn("_size", F.floor(F.col("_n") / (folds + 1)))
    no, parts = F.col("session_no"), [F.struct(F.lit(0).alias("fold"), F.col("in_sample").alias("train"), (~F.col("in_sample")).alias("test"))]
    for i in range(folds):
        end = F.col("_n") - (folds - i) * F.col("_size")
        parts.append(F.struct(F.lit(i + 1).alias("fold"), (no <= end).alias("train"), ((no > end) & (no <= end + F.col("_size"))).alias("test")))
    return rows.select("*", F.inline(F.array(*parts))).filter(F.col("train") | F.col("test")).drop("_n", "_size")


def binned(features: DataFrame, rows: DataFrame, percentiles=PERCENTILES, *, d="d", by=()) -> DataFrame:
    """(by, d, feature, bin): how many of the percentiles over the training rows of the group lie below the value."""
    group = keys(by)
    days = rows.select(*group, d, F.col("train").alias("in_sample")).distinct()
    cuts = in_sample_thresholds(features, days, percentiles, d=d, by=by)
    joined = features.filter(F.col("value").isNotNull()).join(days.select(*group, d), [d]).join(cuts, [*group, "feature"])
    return joined.select(*group, d, "feature", F.size(F.filter("thresholds", lambda t: F.col("value") > t)).alias("bin"))


@dataclass
class Grown:
    """``rows`` with the value of their leaf (array), and ``splits`` (by, tree, node, feature, bin, gain, weights of both sides)."""
    rows: DataFrame
    splits: DataFrame


def grow(rows: DataFrame, bins: DataFrame, width: int, depth: int = 3, share: float = 1.0, min_weight: float = 5.0, seed: int = 42, *, d="d", by=()) -> Grown:
    """One tree per (by, tree) from rows (by, tree, d, w, t), where t holds ``width`` targets. ``share``: part of the features each node looks at."""
    group = [*keys(by), "tree"]
    node = [*group, "node"]
    sums = [F.sum(F.col("w") * F.col("t")[k]).alias(f"s{k}") for k in range(width)]
    state, found = rows.withColumn("node", F.lit(1).cast("bigint")), None
    for level in range(depth):
        seen = state.filter("w > 0").join(bins, [*keys(by), d])
        if share < 1.0:
            seen = seen.filter(F.pmod(F.xxhash64("tree", "node", "feature", F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
        hist = seen.groupBy(*node, "feature", "bin").agg(F.sum("w").alias("w"), *sums)
        total = state.filter("w > 0").groupBy(*node).agg(F.sum("w").alias("W"), *[s.alias(f"S{k}") for k, s in enumerate(sums)])
        above = Window.partitionBy(*node, "feature").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        right = hist.select(*node, "feature", "bin", F.sum("w").over(above).alias("rw"), *[F.sum(f"s{k}").over(above).alias(f"r{k}") for k in range(width)])
        sides = right.filter("rw IS NOT NULL").join(total, node).withColumn("lw", F.col("W") - F.col("rw")).filter((F.col("lw") >= min_weight) & (F.col("rw") >= min_weight))
        gain: Column = F.lit(0.0)
        for k in range(width):
            r, s = F.col(f"r{k}"), F.col(f"S{k}")
            gain = gain + r * r / F.col("rw") + (s - r) * (s - r) / F.col("lw") - s * s / F.col("W")
        sides = sides.withColumn("gain", F.round(gain, 9)).filter("gain > 0")
        best = sides.groupBy(*node).agg(F.min_by(F.struct("feature", "bin", "gain", F.col("lw").alias("left_weight"), F.col("rw").alias("right_weight")), F.struct(-F.col("gain"), "feature", "bin")).alias("_b"))
        splits = materialize(best.select(*node, "_b.*"), f"splits{level}")
        found = splits if found is None else found.unionByName(splits)
        moved = state.join(splits.select(*node, "feature", F.col("bin").alias("_at")), node, "left").join(bins, [*keys(by), d, "feature"], "left")
        side = (F.coalesce(F.col("bin"), F.lit(-1)) > F.col("_at")).cast("bigint")
        state = materialize(moved.withColumn("node", F.when(F.col("_at").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side)).select(*rows.columns, "node"), f"nodes{level}")
    leaves = state.filter("w > 0").groupBy(*node).agg(F.sum("w").alias("W"), *sums)
    leaves = leaves.select(*node, F.array(*[F.col(f"s{k}") / F.col("W") for k in range(width)]).alias("value"))
    return Grown(state.join(leaves, node, "left").drop("node"), found)


def _averaged(rows: DataFrame, group: list, d: str, width: int) -> DataFrame:
    mean = [F.avg(F.col("value")[k]).alias(f"_{k}") for k in range(width)]
    return rows.groupBy(*group, d).agg(*mean).select(*group, d, F.array(*[F.col(f"_{k}") for k in range(width)]).alias("p"))


def _gains(splits: DataFrame, group: list) -> DataFrame:
    """Share of the total gain by feature."""
    out = splits.groupBy(*group, "feature").agg(F.sum("gain").alias("_gain"))
    return out.select(*group, "feature", (F.col("_gain") / F.sum("_gain").over(Window.partitionBy(*group))).alias("importance"))


def forest(rows: DataFrame, bins: DataFrame, width: int, trees: int = 30, depth: int = 4, share: float = 0.5, seed: int = 42, *, d="d", by=()) -> tuple[DataFrame, DataFrame]:
    """Bootstrapped trees that look at ``share`` of the features per node: (predictions p by group and day, importances)."""
    group = keys(by)
    u = F.pmod(F.xxhash64(*group, d, "tree", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    draw = sum(((u > p).cast("double") for p in POISSON), F.lit(0.0))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("w", F.col("w") * draw)
    grown = grow(drawn.select(*group, d, "tree", "w", "t"), bins, width, depth, share, seed=seed, d=d, by=by)
    return materialize(_averaged(grown.rows.filter("value IS NOT NULL"), group, d, width), "forest"), materialize(_gains(grown.splits, group), "importances")


def boosted(rows: DataFrame, bins: DataFrame, width: int, rounds: int = 30, depth: int = 2, rate: float = 0.2, seed: int = 42, *, d="d", by=()) -> tuple[DataFrame, DataFrame]:
    """Trees fitted one after the other to what is left (squared error): (predictions p by group and day, importances)."""
    group, target = keys(by), rows.select(*keys(by), d, "w", F.col("t").alias("_y"))
    start = rows.groupBy(*group).agg(F.array(*[F.sum(F.col("w") * F.col("t")[k]) / F.sum("w") for k in range(width)]).alias("p"))
    state, splits = target.join(start, group), None
    for r in range(rounds):
        left = state.withColumn("t", F.zip_with("_y", "p", lambda y, p: y - p)).withColumn("tree", F.lit(r))
        grown = grow(left.select(*group, d, "tree", "w", "t", "_y", "p"), bins, width, depth, seed=seed, d=d, by=by)
        step = F.when(F.col("value").isNull(), F.col("p")).otherwise(F.zip_with("p", "value", lambda p, v: p + rate * v))
        state = materialize(grown.rows.withColumn("p", step).select(*group, d, "w", "_y", "p"), "boosted")
        splits = grown.splits if splits is None else splits.unionByName(grown.splits)
    return state.select(*group, d, "p"), materialize(_gains(splits, group), "importances")


LEARNERS = {"forest": forest, "boosted": boosted}
CLASSES = 3


def _tasks(rows: DataFrame, tasks: list[str], *, d="d", by=()) -> DataFrame:
    """Rows per task with weight and targets: 'class' (three indicators), 'amount' (the amplitude), 'strong' (class 2, both kinds of rows
    weighing the same in sum)."""
    cat, zero = F.col("y_cat"), F.lit(0.0)
    label = lambda k: F.coalesce((cat == k).cast("double"), zero)
    known = F.col("train") & cat.isNotNull()
    part = Window.partitionBy(*keys(by), "fold")
    rows = rows.withColumns({"_n": F.count_if(known).over(part), "_p": F.count_if(known & (cat == 2)).over(part)})
    n, p, w = F.col("_n"), F.col("_p"), known.cast("double")
    options = {"class": F.struct(F.lit("class").alias("task"), w.alias("w"), F.array(*[label(k) for k in range(CLASSES)]).alias("t")),
               "amount": F.struct(F.lit("amount").alias("task"), w.alias("w"), F.array(F.coalesce("y_amp", zero), zero, zero).alias("t")),
               "strong": F.struct(F.lit("strong").alias("task"), F.when(cat == 2, w * (n - p) / F.greatest(p, F.lit(1))).otherwise(w).alias("w"), F.array(label(2), zero, zero).alias("t"))}
    return rows.select(*keys(by), "fold", d, F.inline(F.array(*[options[x] for x in tasks])))


@dataclass
class GroupModels:
    """``rows`` (by, fold, d, train, test, labels), ``predictions`` (by, fold, task, learner, d, p), ``importances`` (by, fold, task, learner, feature)."""
    rows: DataFrame
    predictions: DataFrame
    importances: DataFrame


def fit(features: DataFrame, sessions: DataFrame, tasks=("class", "amount"), folds: int = 0, learners=("forest", "boosted"), options: dict | None = None, *, d="d", by=("symbol",)) -> GroupModels:
    """Fits every learner on every group, fold and task in one job per level. ``sessions`` come from ``rules.rule_sessions`` with y_cat and y_amp;
    ``options`` holds settings by learner, such as {"forest": {"trees": 10}}."""
    rows = materialize(fold_sessions(sessions, folds, by=by).select(*keys(by), "fold", d, "session_no", "n_sessions", "train", "test", "y_cat", "y_amp"), "fold-rows")
    bins = materialize(binned(features, rows, d=d, by=[*by, "fold"]), "bins")
    work = materialize(_tasks(rows, list(tasks), d=d, by=by), "targets")
    per_task = bins.withColumn("task", F.explode(F.array(*[F.lit(x) for x in tasks])))
    group, out, gains = [*by, "fold", "task"], None, None
    for name in learners:
        p, g = LEARNERS[name](work, per_task, CLASSES, d=d, by=group, **(options or {}).get(name, {}))
        p, g = p.withColumn("learner", F.lit(name)), g.withColumn("learner", F.lit(name))
        out, gains = (p, g) if out is None else (out.unionByName(p), gains.unionByName(g))
    return GroupModels(rows, out, gains)


def _class_of(p="p") -> Column:
    """The first of the largest entries."""
    return (F.array_position(F.col(p), F.array_max(p)) - 1).cast("int")


def amplitude_metrics(models: GroupModels, reliable: float = 55.0, *, d="d", by=("symbol",)) -> DataFrame:
    """K2 by group: in- and out-of-sample accuracy, mean absolute error, sizes, accuracy over the time folds; the learner of highest out-of-sample
    accuracy is the best (the later name of equal ones)."""
    group = [*keys(by), "learner"]
    scored = models.predictions.join(models.rows, [*keys(by), "fold", d])
    right = F.when(F.col("y_cat").isNotNull(), (_class_of() == F.col("y_cat")).cast("double") * 100.0)
    cls = scored.filter("task = 'class'")
    main = cls.filter("fold = 0").groupBy(*group).agg(F.avg(F.when(F.col("train"), right)).alias("acc_is"), F.avg(F.when(F.col("test"), right)).alias("acc_oos"),
                                                     F.count_if("train").alias("n_train"), F.count_if("test").alias("n_test"))
    mae = scored.filter("task = 'amount' AND fold = 0 AND test").groupBy(*group).agg(F.avg(F.abs(F.col("p")[0] - F.col("y_amp"))).alias("mae"))
    folds = cls.filter("fold > 0 AND test").groupBy(*group, "fold").agg(F.avg(right).alias("_a")).groupBy(*group).agg(F.avg("_a").alias("cv_mean"), F.stddev_pop("_a").alias("cv_std"))
    out = main.join(mae, group, "left").join(folds, group, "left").withColumn("is_reliable", F.col("acc_oos") >= reliable)
    best = Window.partitionBy(*keys(by)).orderBy(F.desc("acc_oos"), F.desc("learner"))
    return out.withColumn("is_best", F.row_number().over(best) == 1)


def class_distributions(models: GroupModels, *, d="d", by=("symbol",)) -> DataFrame:
    """Out-of-sample classes by group: predicted ones per learner and observed ones."""
    test = models.rows.filter("fold = 0 AND test")
    seen = models.predictions.filter("task = 'class' AND fold = 0").join(test.select(*keys(by), d), [*keys(by), d])
    predicted = seen.select(*keys(by), F.col("learner").alias("model"), _class_of().alias("category"))
    observed = test.filter("y_cat IS NOT NULL").select(*keys(by), F.lit("observed").alias("model"), F.col("y_cat").cast("int").alias("category"))
    return predicted.unionByName(observed).groupBy(*keys(by), "model", "category").agg(F.count(F.lit(1)).alias("n"))


def score_newest(models: GroupModels, metrics: DataFrame, *, d="d", by=("symbol",)) -> DataFrame:
    """K3 by group: class, amplitude and class probabilities of the newest session from the best learner."""
    best = metrics.filter("is_best").select(*keys(by), "learner")
    p = models.predictions.filter("fold = 0").join(best, [*keys(by), "learner"])
    newest = models.rows.filter("fold = 0").groupBy(*keys(by)).agg(F.max(d).alias(d))
    wide = p.join(newest, [*keys(by), d]).groupBy(*keys(by), d).agg(F.first(F.when(F.col("task") == "class", F.col("p")), ignorenulls=True).alias("p"),
                                                                  F.first(F.when(F.col("task") == "amount", F.col("p")[0]), ignorenulls=True).alias("amplitude"))
    positive = F.transform("p", lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    return wide.select(*keys(by), d, _class_of().alias("category"), "amplitude", F.transform(positive, lambda x: F.try_divide(x, total)).alias("probabilities"))


def select_features(models: GroupModels, features: DataFrame, sessions: DataFrame, max_corr: float = 0.95, n_top: int | None = None, task: str = "class", *, d="d", by=("symbol",)) -> DataFrame:
    """K4 by group: features by mean importance over the time folds (fold 0 without any), without the less important one of every pair correlated
    beyond ``max_corr`` in sample. (by, feature, importance, position)."""
    group = keys(by)
    chosen = models.importances.filter((F.col("task") == task) & (F.col("learner") == "forest"))
    folds = models.rows.groupBy(*group).agg(F.max("fold").alias("_last"))
    used = chosen.join(folds, group).filter((F.col("fold") > 0) | (F.col("_last") == 0))
    mean = used.groupBy(*group, "feature").agg((F.sum("importance") / F.max(F.greatest("_last", F.lit(1)))).alias("importance"))
    inside = features.join(sessions.filter("in_sample").select(*group, d), [d])
    named = inside.select(*group, "feature").distinct().join(mean, [*group, "feature"], "left")
    order = Window.partitionBy(*group).orderBy(F.desc("importance"), "feature")
    ranked = materialize(named.withColumn("importance", F.coalesce("importance", F.lit(0.0))).withColumn("_r", F.row_number().over(order)), "ranked-features")
    a = inside.select(*group, d, F.col("feature").alias("fa"), F.col("value").alias("va"))
    b = inside.select(*group, d, F.col("feature").alias("fb"), F.col("value").alias("vb"))
    close = a.join(b, [*group, d]).filter("fa < fb").groupBy(*group, "fa", "fb").agg(F.corr("va", "vb").alias("r")).filter(F.abs("r") > max_corr)
    both = close.select(*group, F.col("fa").alias("feature"), F.col("fb").alias("other")).unionByName(close.select(*group, F.col("fb").alias("feature"), F.col("fa").alias("other")))
    pairs = both.groupBy(*group, "feature").agg(F.collect_list("other").alias("_close"))

    def keep(pdf):
        """Best first; a feature goes if a kept one is too close. As many rows as features."""
        pdf = pdf.sort_values("_r")
        kept = []
        for name, close in zip(pdf["feature"], pdf["_close"]):
            if close is None or not set(close) & set(kept):
                kept.append(name)
        out = pdf[pdf["feature"].isin(kept)].drop(columns=["_close", "_r"]).reset_index(drop=True)
        out["position"] = range(len(out))
        return out

    kinds = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in [*group, "feature", "importance"])
    rows = ranked.join(pairs, [*group, "feature"], "left").select(*group, "feature", "importance", "_r", "_close")
    out = rows.groupBy(*group).applyInPandas(keep, f"{kinds}, position int")
    return out if n_top is None else out.filter(F.col("position") < n_top)


def top_features(models: GroupModels, n: int | None = None, task: str = "strong", *, by=("symbol",)) -> DataFrame:
    """K5 by group: importance ranking of the in-sample forest for class 2 against the rest."""
    rows = models.importances.filter((F.col("task") == task) & (F.col("learner") == "forest") & (F.col("fold") == 0))
    out = rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys(by)).orderBy(F.desc("importance"), "feature")) - 1).select(*keys(by), "feature", "importance", "position")
    return out if n is None else out.filter(F.col("position") < n)


def _isotonic(pdf, by: list, d: str):
    """Predictions of one group and learner, calibrated by pooling neighbours on the tests of the time folds."""
    import numpy as np
    seen = pdf[(pdf["fold"] > 0) & pdf["test"]].sort_values("p", kind="stable")
    out = pdf[(pdf["fold"] == 0) & pdf["test"]][[*by, "learner", d, "label", "p", "n_test"]].copy()
    if len(seen):
        level, weight, last = [], [], []
        for x, y in zip(seen["p"], seen["label"]):
            level.append(float(y))
            weight.append(1.0)
            last.append(x)
            while len(level) > 1 and (level[-2] >= level[-1] or last[-2] == last[-1]):
                w = weight[-2] + weight[-1]
                level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / w]
                weight[-2:] = [w]
                last[-2:] = [last[-1]]
        at = np.minimum(np.searchsorted(last, out["p"].to_numpy(), side="left"), len(level) - 1)
        out["p"] = np.asarray(level)[at]
    return out.rename(columns={"p": "probability"})


LEVELS = tuple(round(0.40 + 0.05 * i, 2) for i in range(12))


def strong_classifier(models: GroupModels, at: float = 0.70, levels=LEVELS, *, d="d", by=("symbol",)) -> tuple[DataFrame, DataFrame]:
    """K6 by group: (curve, choice). ``curve``: out-of-sample precision, number and signals per quarter of the calibrated probability of class 2
    at each level for every learner, the best one marked. ``choice``: precision of each learner at ``at`` and over the time folds.

    The best learner has the highest out-of-sample precision at ``at``, then the most signals there, then the first name. A group's calibration
    reads its own sessions: as many rows as the calendar has days."""
    group = [*keys(by), "learner"]
    rows = models.rows.join(models.rows.filter("fold = 0").groupBy(*keys(by)).agg(F.count_if("test").alias("n_test")), keys(by))
    p = models.predictions.filter("task = 'strong'").select(*group, "fold", d, F.least(F.greatest(F.col("p")[0], F.lit(0.0)), F.lit(1.0)).alias("p"))
    scored = materialize(p.join(rows.select(*keys(by), "fold", d, "test", "n_test", F.coalesce((F.col("y_cat") == 2).cast("double"), F.lit(0.0)).alias("label")), [*keys(by), "fold", d]), "strong")
    kinds = ", ".join(f"`{c}` {scored.schema[c].dataType.simpleString()}" for c in [*group, d, "label"])
    names = keys(by)
    out = materialize(scored.groupBy(*group).applyInPandas(lambda pdf: _isotonic(pdf, names, d), f"{kinds}, probability double, n_test bigint"), "calibrated")
    per = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("threshold")
    on = F.col("probability") >= F.col("threshold") - 1e-12
    curve = out.select("*", per).groupBy(*group, "threshold").agg(F.count_if(on).alias("n_oos"), F.avg(F.when(on, F.col("label") * 100.0)).alias("precision"), F.max("n_test").alias("_n"))
    curve = curve.withColumn("per_quarter", F.col("n_oos") / F.greatest(F.col("_n") / 63.0, F.lit(1.0))).drop("_n")
    hit = F.col("p") >= at
    folds = scored.filter("fold > 0 AND test").groupBy(*group, "fold").agg(F.avg(F.when(hit, F.col("label") * 100.0)).alias("_f")).groupBy(*group).agg(F.avg("_f").alias("fold_precision"))
    choice = curve.filter(F.abs(F.col("threshold") - at) < 1e-9).select(*group, "precision", "n_oos").join(folds, group, "left")
    order = Window.partitionBy(*keys(by)).orderBy(F.col("precision").desc_nulls_last(), F.desc("n_oos"), "learner")
    choice = materialize(choice.withColumn("is_best", F.row_number().over(order) == 1), "choice")
    return curve.join(choice.select(*group, "is_best"), group), choice


def stump(features: DataFrame, sessions: DataFrame, percentiles=PERCENTILES, min_weight: float = 5.0, *, d="d", by=("symbol",)) -> DataFrame:
    """The best single split of the three classes in sample by group: feature, percentile, rows on both sides, gain of the Gini sum."""
    rows = materialize(fold_sessions(sessions, 0, by=by).select(*keys(by), "fold", d, "train", "test", "y_cat", "y_amp"), "fold-rows")
    bins = binned(features, rows, percentiles, d=d, by=[*by, "fold"])
    work = _tasks(rows, ["class"], d=d, by=by).withColumn("tree", F.lit(0))
    group = [*by, "fold", "task"]
    grown = grow(work, bins.withColumn("task", F.lit("class")), CLASSES, 1, min_weight=min_weight, d=d, by=group)
    percent = F.element_at(F.array(*[F.lit(p) for p in percentiles]), F.col("bin") + 1)
    return grown.splits.select(*keys(by), "feature", percent.alias("percentile"), F.col("left_weight").cast("bigint").alias("n_below"), F.col("right_weight").cast("bigint").alias("n_above"), "gain")
