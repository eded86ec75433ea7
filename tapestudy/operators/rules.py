"""Threshold rules: statistics, walk-forward checks and search.

Features are long (feature, d, value) and dense; ``rule_sessions`` numbers the sessions and marks the sample. Every function takes
``by`` (for example ``["cell"]``) so that a whole grid of targets is one job.

Work is reduced before it fans out: for one-feature rules a session is first counted by the slot its value takes
among the thresholds, and only those few slot counts are spread over the rules; for combinations each condition becomes a bitmap of
64 sessions per word, so pairs meet once per word and are counted with ``bit_count``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, ratio, truth
from ..functions.windows import keys
from ..sources.shared import materialize

PERCENTILES = tuple(range(10, 91, 10))
N_WINDOWS = 8
MIN_IS, MIN_OOS, MIN_PRECISION = 15, 6, 82.0


def rule_sessions(targets: DataFrame, y, is_ratio: float = 0.7, n_windows: int = N_WINDOWS, *, d="d", by=()) -> DataFrame:
    """The rows with ``y`` (boolean), the number of their session, ``in_sample`` (first ``is_ratio``), the walk-forward window
    (1..n, null outside), its length ``window_sessions`` (windows below five sessions are not used) and the number of
    out-of-sample sessions. Sessions are the distinct dates (of each ``by`` group), so the numbering is bounded by the calendar."""
    group = keys(by) if by else []
    days = targets.select(*group, d).distinct()
    order, everything = Window.partitionBy(*group).orderBy(d), Window.partitionBy(*group)
    days = days.withColumns({"session_no": F.row_number().over(order), "n_sessions": F.count(F.lit(1)).over(everything)})
    rows = targets.withColumn("y", truth(y)).join(days, [*group, d])
    split = F.floor(F.col("n_sessions") * is_ratio)
    size = F.floor(F.col("n_sessions") / (n_windows + 1))
    window = F.floor((F.col("session_no") - 1) / F.when(size > 0, size))
    return rows.withColumns({"in_sample": F.col("session_no") <= split, "oos_sessions": F.col("n_sessions") - split,
                             "window": F.when((size >= 5) & window.between(1, n_windows), window), "window_sessions": size})


def _counter_conditions(n_windows: int) -> dict[str, Column]:
    inside, y, w = F.col("in_sample"), F.col("y"), F.col("window")
    out = {"n_is": inside, "h_is": inside & y, "n_oos": ~inside, "h_oos": ~inside & y}
    for i in range(1, n_windows + 1):
        out |= {f"w{i}_n": w == i, f"w{i}_h": (w == i) & y}
    return out


def _counters(n_windows: int):
    """Aggregates over session rows."""
    return [count_where(c).alias(k) for k, c in _counter_conditions(n_windows).items()] + [F.max("oos_sessions").alias("oos_sessions")]


def _sum_counters(n_windows: int):
    return [F.sum(k).alias(k) for k in _counter_conditions(n_windows)] + [F.max("oos_sessions").alias("oos_sessions")]


def rule_metrics(counts: DataFrame, n_windows: int = N_WINDOWS, min_precision: float = MIN_PRECISION, valid_share: float = 0.75) -> DataFrame:
    """Precisions in and out of sample, leakage flag, signals per quarter (63 sessions), and the walk-forward figures from
    the counters. A window needs two hits; a rule is robust if max(2, ``valid_share`` of the tested windows) reach the precision."""
    precision = {"precision_is": ratio("h_is", "n_is") * 100.0, "precision_oos": ratio("h_oos", "n_oos") * 100.0}
    out = counts.withColumns(precision | {f"_p{i}": F.when(F.col(f"w{i}_n") >= 2, ratio(f"w{i}_h", f"w{i}_n") * 100.0) for i in range(1, n_windows + 1)})
    ps = F.array_compact(F.array(*[F.col(f"_p{i}") for i in range(1, n_windows + 1)]))
    out = out.withColumn("precisions_by_window", ps)
    p = F.col("precisions_by_window")
    tested = F.size(p)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, tested)
    out = out.withColumns({"n_windows_tested": tested, "n_windows_valid": F.size(F.filter(p, lambda x: x >= min_precision)), "mean_precision_wf": mean})
    spread = F.sqrt(F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - F.col("mean_precision_wf")) * (x - F.col("mean_precision_wf"))), F.col("n_windows_tested")))
    need = F.greatest(F.lit(2), F.floor(F.col("n_windows_tested") * valid_share))
    out = out.withColumns({
        "std_precision_wf": spread, "is_robust": F.col("n_windows_valid") >= need,
        "leakage_suspect": truth((F.col("precision_oos") - F.col("precision_is") > 30) & (F.col("n_oos") < 20)),
        "per_quarter_oos": F.round(F.col("n_oos") / F.greatest(F.col("oos_sessions") / 63.0, F.lit(1.0)), 1)})
    return out.drop(*_counter_conditions(n_windows).keys() - {"n_is", "n_oos"}, *[f"_p{i}" for i in range(1, n_windows + 1)])


def passing(metrics: DataFrame, min_is: int = MIN_IS, min_oos: int = MIN_OOS, min_precision: float | None = MIN_PRECISION) -> DataFrame:
    """Rules with enough occurrences that are not suspect and reach the out-of-sample precision."""
    out = metrics.filter((F.col("n_is") >= min_is) & (F.col("n_oos") >= min_oos))
    if min_precision is not None:
        out = out.filter(~F.col("leakage_suspect") & (F.col("precision_oos") >= min_precision))
    return out


def rule_stats(hits: DataFrame, sessions: DataFrame, min_is: int = MIN_IS, min_oos: int = MIN_OOS, n_windows: int = N_WINDOWS,
               min_precision: float = MIN_PRECISION, *, rule="rule_id", d="d", by=()) -> DataFrame:
    """I6 and I7 for given rules: ``hits`` holds (rule, d) where the rule is true. Rules with too few hits are dropped."""
    group = keys(by) if by else []
    counts = hits.join(sessions, [*group, d]).groupBy(*group, rule).agg(*_counters(n_windows))
    return passing(rule_metrics(counts, n_windows, min_precision), min_is, min_oos, None)


def walk_forward(hits: DataFrame, sessions: DataFrame, n_windows: int = N_WINDOWS, min_precision: float = MIN_PRECISION, valid_share: float = 0.75, *,
                 rule="rule_id", d="d", by=()) -> DataFrame:
    """I7 alone: walk-forward figures of every rule that fires at least once."""
    group = keys(by) if by else []
    counts = hits.join(sessions, [*group, d]).groupBy(*group, rule).agg(*_counters(n_windows))
    return rule_metrics(counts, n_windows, min_precision, valid_share).select(
        *group, rule, "n_windows_tested", "n_windows_valid", "is_robust", "mean_precision_wf", "std_precision_wf", "precisions_by_window")


def in_sample_thresholds(features: DataFrame, sessions: DataFrame, percentiles=PERCENTILES, *, d="d", by=()) -> DataFrame:
    """The interpolated percentiles of every feature over the in-sample sessions, as an array."""
    group = keys(by) if by else []
    rows = features.join(sessions.filter("in_sample").select(*group, d), [d])
    return rows.groupBy(*group, "feature").agg(F.percentile("value", F.array(*[F.lit(p / 100) for p in percentiles])).alias("thresholds"))


def univariate_counts(features: DataFrame, sessions: DataFrame, percentiles=PERCENTILES, n_windows: int = N_WINDOWS, *, d="d", by=()) -> DataFrame:
    """Counters of every (feature, percentile, direction); ``above`` is value >= threshold, ``below`` is value <= threshold."""
    group = keys(by) if by else []
    thresholds = in_sample_thresholds(features, sessions, percentiles, d=d, by=by)
    rows = features.filter(F.col("value").isNotNull()).join(sessions, [d]).join(thresholds, [*group, "feature"])
    v = F.col("value")
    slots = rows.withColumns({"_ge": F.size(F.filter("thresholds", lambda t: v >= t)), "_gt": F.size(F.filter("thresholds", lambda t: v > t))})
    slots = slots.groupBy(*group, "feature", "_ge", "_gt").agg(*_counters(n_windows), F.first("thresholds").alias("thresholds"))
    options = []
    for i, p in enumerate(percentiles):
        for direction, holds in (("above", F.col("_ge") > i), ("below", F.col("_gt") <= i)):
            options.append(F.struct(F.lit(p).alias("percentile"), F.lit(direction).alias("direction"), F.col("thresholds")[i].alias("threshold"), holds.alias("_on")))
    names = [k for k in _counter_conditions(n_windows)]
    spread = slots.select(*group, "feature", *names, "oos_sessions", F.inline(F.array(*options))).filter("_on")
    return spread.groupBy(*group, "feature", "percentile", "direction", "threshold").agg(*_sum_counters(n_windows))


def condition(feature="feature", direction="direction", threshold="threshold", percentile="percentile") -> Column:
    return F.struct(F.col(feature).alias("feature"), F.col(direction).alias("direction"), F.col(threshold).alias("threshold"), F.col(percentile).alias("percentile"))


def univariate_rules(features: DataFrame, sessions: DataFrame, percentiles=PERCENTILES, min_is: int = MIN_IS, min_oos: int = MIN_OOS,
                     min_precision: float | None = MIN_PRECISION, n_windows: int = N_WINDOWS, *, d="d", by=()) -> DataFrame:
    """I8: every feature at nine percentiles in two directions, kept by out-of-sample precision."""
    return single_rules(univariate_counts(features, sessions, percentiles, n_windows, d=d, by=by), min_is, min_oos, min_precision, n_windows)


def single_rules(counts: DataFrame, min_is: int = MIN_IS, min_oos: int = MIN_OOS, min_precision: float | None = MIN_PRECISION, n_windows: int = N_WINDOWS) -> DataFrame:
    """I8 from the counters of all (feature, percentile, direction)."""
    out = passing(rule_metrics(counts, n_windows, min_precision or MIN_PRECISION), min_is, min_oos, min_precision)
    rule_id = F.concat_ws(":", "feature", "direction", F.col("percentile").cast("string"))
    return out.withColumns({"rule_id": rule_id, "kind": F.lit("univariate"), "op": F.lit("AND"), "features": F.array("feature"), "conditions": F.array(condition())})


def rule_dates(rules: DataFrame, features: DataFrame, sessions: DataFrame, out_of_sample: bool = True, *, d="d", by=()) -> DataFrame:
    """The sessions on which AND/OR rules hold (for the kept rules only): (rule_id, d)."""
    group = keys(by) if by else []
    lines = rules.select(*group, "rule_id", "op", F.size("conditions").alias("_k"), F.inline("conditions"))
    chosen = sessions.filter(~F.col("in_sample")) if out_of_sample else sessions
    rows = features.join(chosen.select(*group, d), [d]).join(lines, [*group, "feature"])
    met = F.when(F.col("direction") == "above", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    held = rows.filter(met).groupBy(*group, "rule_id", d).agg(F.count(F.lit(1)).alias("_met"), F.first("_k").alias("_k"), F.first("op").alias("op"))
    return held.filter((F.col("_met") == F.col("_k")) | (F.col("op") == "OR")).select(*group, "rule_id", d)


def best_threshold_per_feature(features: DataFrame, sessions: DataFrame, percentiles=PERCENTILES, min_is: int = MIN_IS, digits: int | None = 4, *,
                               d="d", by=()) -> DataFrame:
    """Per feature the percentile and direction with the best in-sample precision; the first in order wins ties. Thresholds
    are rounded to ``digits`` as the combined rules use them."""
    return best_of_counts(univariate_counts(features, sessions, percentiles, 1, d=d, by=by), min_is, digits, by=by)


def best_of_counts(counts: DataFrame, min_is: int = MIN_IS, digits: int | None = 4, *, by=()) -> DataFrame:
    """I9 from the counters of all (feature, percentile, direction)."""
    group = keys(by) if by else []
    counts = counts.filter(F.col("n_is") >= min_is)
    counts = counts.withColumn("precision_is", ratio("h_is", "n_is") * 100.0).filter(F.col("precision_is") > 0)
    order = Window.partitionBy(*group, "feature").orderBy(F.col("precision_is").desc(), "percentile", "direction")
    best = counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    threshold = F.col("threshold") if digits is None else F.round("threshold", digits)
    return best.select(*group, "feature", "direction", threshold.alias("threshold"), "percentile", "precision_is", "n_is")


def literal_bits(features: DataFrame, sessions: DataFrame, literals: DataFrame, *, d="d", by=()) -> DataFrame:
    """Bitmaps of single conditions: 64 sessions per word."""
    group = keys(by) if by else []
    rows = features.join(sessions.select(*group, d, "session_no"), [d]).join(literals.select(*group, "feature", "direction", "threshold", "percentile"), [*group, "feature"])
    met = F.when(F.col("direction") == "above", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    rows = rows.withColumns({"word": F.floor((F.col("session_no") - 1) / 64).cast("int"), "_bit": ((F.col("session_no") - 1) % 64).cast("int"), "_met": truth(met)})
    bit = F.when(F.col("_met"), F.expr("shiftleft(1L, _bit)")).otherwise(F.lit(0).cast("bigint"))
    return rows.groupBy(*group, "feature", "word").agg(F.bit_or(bit).alias("bits"), F.first(condition()).alias("condition"))


def session_masks(sessions: DataFrame, n_windows: int = N_WINDOWS, *, by=()) -> DataFrame:
    """Bitmaps of the sessions that enter each counter."""
    group = keys(by) if by else []
    rows = sessions.withColumns({"word": F.floor((F.col("session_no") - 1) / 64).cast("int"), "_bit": ((F.col("session_no") - 1) % 64).cast("int")})
    bit = F.expr("shiftleft(1L, _bit)")
    zero = F.lit(0).cast("bigint")
    return rows.groupBy(*group, "word").agg(*[F.bit_or(F.when(truth(c), bit).otherwise(zero)).alias(f"m_{k}") for k, c in _counter_conditions(n_windows).items()],
                                            F.max("oos_sessions").alias("oos_sessions"))


def bitmap_counts(rules: DataFrame, masks: DataFrame, n_windows: int = N_WINDOWS, *, by=(), keep=("rule_id", "op")) -> DataFrame:
    """Counters of rules given by (rule, word, bits)."""
    group = keys(by) if by else []
    rows = rules.join(masks, [*group, "word"])
    counted = [F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col(f"m_{k}")))).alias(k) for k in _counter_conditions(n_windows)]
    return rows.groupBy(*group, *keep).agg(*counted, F.max("oos_sessions").alias("oos_sessions"), F.first("features").alias("features"), F.first("conditions").alias("conditions"))


#: The four counters that decide whether a rule passes; the others are counted for passing rules alone.
DECIDING = ("n_is", "h_is", "n_oos", "h_oos")
#: Features are dealt into so many blocks, and pairs meet per pair of blocks and word.
BLOCKS = 8


def needed_hits(min_oos: int, min_precision: float | None) -> int:
    """The out-of-sample hits that every passing rule has: at least ``min_precision`` of at least ``min_oos`` occurrences. A
    conjunction can only lose hits, so one with fewer has no extension that passes."""
    return 0 if min_precision is None else math.ceil(min_oos * min_precision / 100.0 - 1e-9)


def _decided(rows: DataFrame, masks: DataFrame, rule, *first, by=(), words: bool = False) -> DataFrame:
    """The deciding counters of (rule, word, bits), with the bitmaps as one array of (word, bits) if ``words``: as long as the calendar."""
    group = keys(by) if by else []
    rows = rows.join(masks.select(*group, "word", *[f"m_{k}" for k in DECIDING], "oos_sessions"), [*group, "word"])
    counted = [F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col(f"m_{k}")))).alias(k) for k in DECIDING]
    kept = [F.collect_list(F.struct("word", "bits")).alias("words")] if words else []
    return rows.groupBy(*group, *rule).agg(*counted, F.max("oos_sessions").alias("oos_sessions"), *[F.first(c).alias(c) for c in first], *kept)


def _may_pass(min_is: int, min_oos: int, min_precision: float | None) -> Column:
    """``passing`` from the deciding counters alone."""
    ok = (F.col("n_is") >= min_is) & (F.col("n_oos") >= min_oos)
    if min_precision is None:
        return ok
    p_is, p_oos = ratio("h_is", "n_is") * 100.0, ratio("h_oos", "n_oos") * 100.0
    return ok & ~truth((p_oos - p_is > 30) & (F.col("n_oos") < 20)) & truth(p_oos >= min_precision)


def _dealt(rows: DataFrame, feature, mine: str, other: str) -> DataFrame:
    """Rows with the block of their feature and a copy for every block of the other side: two features meet in one place."""
    return rows.withColumns({mine: F.pmod(F.xxhash64(feature), F.lit(BLOCKS)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))})


def combo2_rules(bits: DataFrame, masks: DataFrame, min_is: int = MIN_IS, min_oos: int = MIN_OOS, min_precision: float | None = MIN_PRECISION,
                 n_windows: int = N_WINDOWS, *, by=()) -> DataFrame:
    """Every pair of conditions, joined by AND and by OR, with enough occurrences and precision. ``bits`` are the bitmaps of the conditions.

    Only pairs that can still pass meet: for AND both sides need the hits of a passing rule, for OR the hits of both sides together
    must reach the precision over the occurrences of the larger one. The counts of OR are A + B - AND; walk-forward windows are
    counted for passing rules alone."""
    group = keys(by) if by else []
    counts = pair_counts(bits, masks, min_oos, min_precision, by=by)
    rules = counts.filter(_may_pass(min_is, min_oos, min_precision)).select(*group, "features", "conditions", "op")
    a = bits.select(*group, "word", F.col("feature").alias("_fa"), F.col("bits").alias("_ba"))
    b = bits.select(*group, "word", F.col("feature").alias("_fb"), F.col("bits").alias("_bb"))
    sides = rules.withColumns({"_fa": F.col("features")[0], "_fb": F.col("features")[1]}).join(a, [*group, "_fa"]).join(b, [*group, "_fb", "word"])
    joint = F.when(F.col("op") == "AND", F.col("_ba").bitwiseAND(F.col("_bb"))).otherwise(F.col("_ba").bitwiseOR(F.col("_bb")))
    rows = sides.select(*group, "word", "features", "conditions", "op", joint.alias("bits"), F.concat(F.col("features")[0], F.lit(" "), F.col("op"), F.lit(" "), F.col("features")[1]).alias("rule_id"))
    out = passing(rule_metrics(bitmap_counts(rows, masks, n_windows, by=by), n_windows, min_precision or MIN_PRECISION), min_is, min_oos, min_precision)
    return out.withColumn("kind", F.concat(F.lit("combo2_"), "op"))


def pair_counts(bits: DataFrame, masks: DataFrame, min_oos: int = MIN_OOS, min_precision: float | None = MIN_PRECISION, *, by=()) -> DataFrame:
    """Deciding counters of the AND and the OR of every pair of conditions that can pass by the counts of its sides."""
    group = keys(by) if by else []
    alone = _decided(bits, masks, ["feature"], by=by).drop("oos_sessions")
    rows = bits.join(alone, [*group, "feature"])
    side = lambda x: rows.select(*group, "word", *[F.col(c).alias(f"{c}_{x}") for c in ("feature", "condition", "bits", *DECIDING)])
    a, b = _dealt(side("a"), "feature_a", "_i", "_j"), _dealt(side("b"), "feature_b", "_j", "_i")
    need, near = needed_hits(min_oos, min_precision), 1.0 - 1e-9
    meet = F.col("feature_a") < F.col("feature_b")
    if min_precision is not None:
        for_and = F.least("h_oos_a", "h_oos_b") >= need
        for_or = (F.col("h_oos_a") + F.col("h_oos_b")) * 100.0 >= F.greatest("n_oos_a", "n_oos_b") * (min_precision * near)
        meet = meet & (for_and | for_or)
    pairs = a.join(b, [*group, "_i", "_j", "word"]).filter(meet)
    sides = [f"{k}_{x}" for k in DECIDING for x in "ab"]
    rows = pairs.select(*group, "word", F.array("feature_a", "feature_b").alias("features"), F.array("condition_a", "condition_b").alias("conditions"),
                        F.col("bits_a").bitwiseAND(F.col("bits_b")).alias("bits"), *sides)
    both = _decided(rows, masks, ["features"], "conditions", *sides, by=by)
    ops = F.inline(F.array(*[F.struct(F.lit(op).alias("op"), *[(F.col(k) if op == "AND" else F.col(f"{k}_a") + F.col(f"{k}_b") - F.col(k)).alias(f"_{k}") for k in DECIDING]) for op in ("AND", "OR")]))
    out = both.select(*group, "features", "conditions", "oos_sessions", ops)
    return out.withColumnsRenamed({f"_{k}": k for k in DECIDING})


# Fixed values of the beam: for each size the number of parents whose features are excluded, extra features tried, and parents extended.
BEAM = {3: (5, 15, 10), 4: (3, 10, 3), 5: (2, 8, 2)}


def supported_combinations(bits: DataFrame, masks: DataFrame, max_k: int, min_is: int = MIN_IS, min_oos: int = MIN_OOS, min_precision: float | None = MIN_PRECISION, *, by=()):
    """AND-combinations level by level, as (size, candidates) from 2 on: branch and bound.

    A candidate of a level is the union of two supported combinations of the level before that differ in their last feature. It is supported with
    ``min_is`` sessions in and ``min_oos`` out of sample and the hits that a passing rule needs; extensions can only lose all three,
    so nothing below an unsupported one can pass. Candidates carry their deciding counters, ``supported``, and if so their bitmaps."""
    group = keys(by) if by else []
    need = needed_hits(min_oos, min_precision)
    supported = (F.col("n_is") >= min_is) & (F.col("n_oos") >= min_oos) & (F.col("h_oos") >= need)
    level = bits.select(*group, "word", F.array("feature").alias("features"), F.array("condition").alias("conditions"), "bits")
    alone = _decided(level, masks, ["features"], by=by).filter(supported)
    level = level.join(alone.select(*group, "features"), [*group, "features"], "left_semi")
    for k in range(2, max_k + 1):
        prefix, last = F.slice("features", 1, k - 2), F.element_at("features", -1)
        a = level.select(*group, "word", prefix.alias("_prefix"), "features", "conditions", "bits")
        b = level.select(*group, "word", prefix.alias("_prefix"), last.alias("_feature"), F.element_at("conditions", -1).alias("_condition"), F.col("bits").alias("_bits"))
        spread = []
        if k == 2:  # no prefix yet: features meet per pair of blocks
            a, b, spread = _dealt(a, F.element_at("features", -1), "_i", "_j"), _dealt(b, "_feature", "_j", "_i"), ["_i", "_j"]
        wider = a.join(b, [*group, "_prefix", "word", *spread]).filter(F.element_at("features", -1) < F.col("_feature"))
        wider = wider.select(*group, "word", F.array_append("features", F.col("_feature")).alias("features"), F.array_append("conditions", F.col("_condition")).alias("conditions"),
                             F.col("bits").bitwiseAND(F.col("_bits")).alias("bits"))
        counts = _decided(wider, masks, ["features"], "conditions", by=by, words=True).withColumn("supported", supported)
        counts = materialize(counts.withColumn("words", F.when(F.col("supported"), F.col("words"))), f"combo{k}")
        yield k, counts
        level = counts.filter("supported").select(*group, "features", "conditions", F.inline("words"))


def search_levels(bits: DataFrame, masks: DataFrame, max_k: int = 5, min_is: int = MIN_IS, min_oos: int = MIN_OOS, min_precision: float | None = MIN_PRECISION, *, by=()) -> DataFrame:
    """How far the search of AND-combinations is cut: candidates that enter each level and those that go on to the next."""
    group, out = keys(by) if by else [], None
    for k, counts in supported_combinations(bits, masks, max_k, min_is, min_oos, min_precision, by=by):
        level = counts.groupBy(*group).agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_candidates"), F.count_if("supported").alias("n_supported"))
        out = level if out is None else out.unionByName(level)
    return out


def combo_k_rules(pairs: DataFrame, bits: DataFrame, masks: DataFrame, max_k: int = 5, min_is: int = MIN_IS, min_oos: int = MIN_OOS,
                  min_precision: float | None = MIN_PRECISION, n_windows: int = N_WINDOWS, beam=None, order: DataFrame | None = None, *, by=()) -> DataFrame:
    """AND-combinations of three to ``max_k`` conditions: all with enough occurrences that reach the precision.

    ``beam`` (for example BEAM) asks for the cheaper search that extends only the best pairs to triples, the best triples to quadruples
    and so on; ``order`` then ranks the features (feature, position) for the choice of extra ones; by name without it. Equal combinations
    reached twice are kept once.

    Without a beam the search is exact: ``supported_combinations`` drops only what no passing rule can extend. At most ``max_k`` - 1 steps;
    each is one equality join of bitmaps, and each result is written to the shared folder before the next step reads it.
    """
    group = keys(by) if by else []
    if beam is None:
        out = None
        for k, counts in supported_combinations(bits, masks, max_k, min_is, min_oos, min_precision, by=by):
            if k >= 3:
                kept = counts.filter("supported").filter(_may_pass(min_is, min_oos, min_precision))
                rows = kept.select(*group, "features", "conditions", F.lit("AND").alias("op"), F.concat_ws(" AND ", "features").alias("rule_id"), F.inline("words"))
                step = passing(rule_metrics(bitmap_counts(rows, masks, n_windows, by=by), n_windows, min_precision or MIN_PRECISION), min_is, min_oos, min_precision)
                step = step.withColumn("kind", F.lit(f"combo{k}_AND"))
                out = step if out is None else out.unionByName(step)
        return out
    part = Window.partitionBy(F.lit(1), *group)
    literals = bits.select(*group, "feature").distinct()
    if order is not None:
        literals = literals.join(order.select("feature", "position"), "feature", "left")
    else:
        literals = literals.withColumn("position", F.lit(0))
    found, parents = [], pairs
    for k in range(3, max_k + 1):
        n_excluded, n_extra, n_parents = beam[k]
        ranked = parents.withColumn("_rank", F.row_number().over(part.orderBy(F.col("precision_oos").desc(), "rule_id"))).filter(F.col("_rank") <= max(n_excluded, n_parents))
        taken = ranked.filter(F.col("_rank") <= n_excluded).select(*group, F.explode("features").alias("feature")).distinct()
        extra = literals.join(taken, [*group, "feature"], "left_anti")
        extra = extra.withColumn("_r", F.row_number().over(part.orderBy("position", "feature"))).filter(F.col("_r") <= n_extra).drop("_r", "position")
        members = ranked.filter(F.col("_rank") <= n_parents).select(*group, F.col("features").alias("_parent"), F.explode("features").alias("feature"))
        joint = members.join(bits, [*group, "feature"]).groupBy(*group, "_parent", "word").agg(F.bit_and("bits").alias("_bits"), F.array_sort(F.collect_set("condition")).alias("_conds"))
        added = bits.join(extra, [*group, "feature"], "left_semi")
        rules = joint.join(added, [*group, "word"]).filter(~F.array_contains("_parent", F.col("feature")))
        names = F.array_sort(F.array_append("_parent", F.col("feature")))
        rules = rules.select(*group, "word", names.alias("features"), F.array_sort(F.array_append("_conds", F.col("condition"))).alias("conditions"),
                             F.col("_bits").bitwiseAND(F.col("bits")).alias("bits"), F.lit("AND").alias("op"), F.concat_ws(" AND ", names).alias("rule_id"))
        rules = rules.dropDuplicates([*group, "rule_id", "word"])
        step = passing(rule_metrics(bitmap_counts(rules, masks, n_windows, by=by), n_windows, min_precision or MIN_PRECISION), min_is, min_oos, min_precision)
        parents = materialize(step.withColumn("kind", F.lit(f"combo{k}_AND")), f"combo{k}")
        found.append(parents)
    out = found[0]
    for step in found[1:]:
        out = out.unionByName(step)
    return out


RESULT = ["rule_id", "kind", "op", "features", "conditions", "n_is", "n_oos", "precision_is", "precision_oos", "leakage_suspect", "per_quarter_oos",
          "n_windows_tested", "n_windows_valid", "is_robust", "mean_precision_wf", "std_precision_wf", "precisions_by_window"]


def all_rules(counts: DataFrame, bits: DataFrame, masks: DataFrame, max_k: int, min_is: int, min_oos: int, min_precision: float | None, n_windows: int = N_WINDOWS,
              beam=None, order: DataFrame | None = None, *, by=()) -> DataFrame:
    """One-feature rules, pairs and larger combinations that pass, from one-feature counters and the bitmaps of the chosen conditions."""
    group = keys(by) if by else []
    pairs = materialize(combo2_rules(bits, masks, min_is, min_oos, min_precision, n_windows, by=by), "combo2") if max_k >= 2 else None
    parts = [single_rules(counts, min_is, min_oos, min_precision, n_windows)] + ([pairs] if max_k >= 2 else [])
    if max_k >= 3:
        parts.append(combo_k_rules(pairs, bits, masks, max_k, min_is, min_oos, min_precision, n_windows, beam, order, by=by))
    out = parts[0].select(*group, *RESULT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*group, *RESULT))
    return out


def search_rules(features: DataFrame, sessions: DataFrame, max_k: int = 3, min_is: int = MIN_IS, min_oos: int = MIN_OOS, min_precision: float = MIN_PRECISION,
                 min_per_quarter: float | None = 3.0, order: DataFrame | None = None, n_windows: int = N_WINDOWS, beam=None, pool: DataFrame | None = None,
                 dates: bool = False, *, d="d", by=()) -> DataFrame:
    """One-feature rules and combinations together, marked ``actionable`` (precision, occurrences, not suspect, per quarter; the
    last test only if ``min_per_quarter`` is given) and ranked robust first. The target is in ``sessions.y``.

    ``pool`` (a frame with a feature column, such as K5's ranking) restricts the features; ``beam`` restricts the combinations beyond pairs;
    ``dates`` adds ``oos_dates``, the out-of-sample sessions on which a rule holds."""
    group = keys(by) if by else []
    if pool is not None:
        features = features.join(pool.select("feature").distinct(), "feature", "left_semi")
    counts = materialize(univariate_counts(features, sessions, PERCENTILES, n_windows, d=d, by=by), "one-feature-counts")
    literals = best_of_counts(counts, min_is, by=by)
    bits = materialize(literal_bits(features, sessions, literals, d=d, by=by), "bits")
    masks = materialize(session_masks(sessions, n_windows, by=by), "masks")
    out = all_rules(counts, bits, masks, max_k, min_is, min_oos, min_precision, n_windows, beam, order, by=by)
    keep = (F.col("precision_oos") >= min_precision) & (F.col("n_oos") >= min_oos) & ~F.col("leakage_suspect")
    if min_per_quarter is not None:
        keep = keep & (F.col("per_quarter_oos") >= min_per_quarter)
    # the rank within (robust, valid windows) plus the rules before that part: no window over all rules
    part = ["is_robust", "n_windows_valid"]
    inner = Window.partitionBy(*group, *part).orderBy(F.col("precision_oos").desc(), F.col("per_quarter_oos").desc(), "kind", "rule_id")
    before = Window.partitionBy(*group).orderBy(F.col("is_robust").desc(), F.col("n_windows_valid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = out.groupBy(*group, *part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = out.withColumns({"actionable": keep, "_inner": F.row_number().over(inner)}).join(sizes, [*group, *part])
    out = out.withColumn("rank", (F.col("_inner") + F.col("_before")).cast("int")).drop("_inner", "_before")
    if dates:
        held = rule_dates(out, features, sessions, d=d, by=by).groupBy(*group, "rule_id").agg(F.array_sort(F.collect_list(d)).alias("oos_dates"))
        out = out.join(held, [*group, "rule_id"], "left")
    return out


MOVES, CAPS = (0.45, 0.40, 0.35, 0.30), (22.0, 21.0, 20.0, 19.0)


def grid_sessions(targets: DataFrame, level_caps=CAPS, is_ratio: float = 0.7, n_windows: int = N_WINDOWS, *, d="d", level="level", by=()) -> DataFrame:
    """The sessions of every level cap within ``by`` (such as symbol, entry, horizon). All move thresholds of a cap have the same
    sessions. ``targets`` holds the amplitude and the day's level; the result is keyed by ``by`` and ``level_cap``."""
    rows = targets.select("*", F.explode(F.array(*[F.lit(float(c)) for c in level_caps])).alias("level_cap")).filter(F.col(level) <= F.col("level_cap"))
    return rule_sessions(rows, F.lit(False), is_ratio, n_windows, d=d, by=[*by, "level_cap"]).drop("y")


def grid_cells(sessions: DataFrame, move_thresholds=MOVES, min_sessions: int = 30, min_positive: int = 20, n_windows: int = N_WINDOWS, *, amplitude="y_amp", by=()) -> tuple[DataFrame, DataFrame]:
    """(cells, masks) of every (``by``, level_cap, move_threshold) with enough sessions and positives. A cell differs from the others of
    its cap in its hits alone, so it is a set of bitmaps over the sessions of the cap. Cells are keyed by their values."""
    cell = [*by, "level_cap", "move_threshold"]
    rows = sessions.select("*", F.explode(F.array(*[F.lit(float(t)) for t in move_thresholds])).alias("move_threshold")).withColumn("y", truth(F.col(amplitude) >= F.col("move_threshold")))
    cells = rows.groupBy(*cell).agg(F.max("n_sessions").alias("n_sessions"), count_where("y").alias("n_positive"), count_where("in_sample").alias("n_is"))
    cells = cells.filter((F.col("n_sessions") >= min_sessions) & (F.col("n_positive") >= min_positive))
    masks = session_masks(rows, n_windows, by=cell).join(cells.select(*cell), cell, "left_semi")
    return cells, masks


def percentile_bits(features: DataFrame, sessions: DataFrame, percentiles=PERCENTILES, digits: int = 4, *, d="d", by=()) -> DataFrame:
    """Bitmaps of every (feature, percentile, direction) over the sessions of each ``by`` group: ``bits`` at the exact threshold, ``bits_rounded`` at
    the rounded one that combinations use. One aggregate makes all of them."""
    group = keys(by) if by else []
    thresholds = in_sample_thresholds(features, sessions, percentiles, d=d, by=by)
    rows = features.filter(F.col("value").isNotNull()).join(sessions.select(*group, d, "session_no"), [d]).join(thresholds, [*group, "feature"])
    rows = rows.withColumns({"word": F.floor((F.col("session_no") - 1) / 64).cast("int"), "_bit": F.expr("shiftleft(1L, cast((session_no - 1) % 64 as int))")})
    v, zero, aggs, parts = F.col("value"), F.lit(0).cast("bigint"), [F.first("thresholds").alias("_t")], []
    for i, p in enumerate(percentiles):
        exact = F.col("thresholds")[i]
        for direction, holds in (("above", lambda t: v >= t), ("below", lambda t: v <= t)):
            name = f"{direction}{i}"
            aggs += [F.bit_or(F.when(holds(t), F.col("_bit")).otherwise(zero)).alias(f"{x}{name}") for x, t in (("e", exact), ("r", F.round(exact, digits)))]
            parts.append(F.struct(F.lit(p).alias("percentile"), F.lit(direction).alias("direction"), F.col("_t")[i].alias("threshold"), F.col(f"e{name}").alias("bits"), F.col(f"r{name}").alias("bits_rounded")))
    return rows.groupBy(*group, "feature", "word").agg(*aggs).select(*group, "feature", "word", F.inline(F.array(*parts)))


def search_grid(features: DataFrame, sessions: DataFrame, move_thresholds=MOVES, max_k: int = 2, min_precision: float = MIN_PRECISION, good: float = 90.0, fair: float = 87.0,
                min_per_quarter: float = 2.0, min_is: int = MIN_IS, min_oos: int = MIN_OOS, n_windows: int = N_WINDOWS, *, d="d", amplitude="y_amp", by=()) -> DataFrame:
    """The best rule of every cell as one job: at least ``good`` out of sample, robust ones first, then by precision, occurrences and
    rule_id; green if robust, yellow if at least ``fair``, red without one. ``sessions`` come from ``grid_sessions``.

    The bitmaps of all conditions are made once per level cap and read by all its cells."""
    base, cell = [*by, "level_cap"], [*by, "level_cap", "move_threshold"]
    cells, masks = grid_cells(sessions, move_thresholds, n_windows=n_windows, amplitude=amplitude, by=by)
    cells, masks = materialize(cells, "cells"), materialize(masks, "masks")
    words = materialize(percentile_bits(features, sessions, d=d, by=base), "bits")
    literal = ["feature", "percentile", "direction"]
    counted = [F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col(f"m_{k}")))).alias(k) for k in _counter_conditions(n_windows)]
    counts = words.drop("bits_rounded").join(masks, [*base, "word"]).groupBy(*cell, *literal, "threshold").agg(*counted, F.max("oos_sessions").alias("oos_sessions"))
    counts = materialize(counts, "one-feature-counts")
    best = best_of_counts(counts, min_is, by=cell).select(*cell, *literal, F.col("threshold").alias("_rounded"))
    chosen = words.drop("threshold", "bits").join(best, [*base, *literal]).withColumnsRenamed({"_rounded": "threshold", "bits_rounded": "bits"})
    bits = materialize(chosen.select(*cell, "feature", "word", "bits", condition().alias("condition")), "cell-bits")
    rules = all_rules(counts, bits, masks, max_k, min_is, min_oos, min_precision, n_windows, by=cell)
    fit = rules.filter((F.col("precision_oos") >= good) & (F.col("n_oos") >= min_oos) & (F.col("per_quarter_oos") >= min_per_quarter) & ~F.col("leakage_suspect"))
    top = fit.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_good"), count_where("is_robust").alias("n_robust"),
        F.max_by(F.struct("rule_id", "precision_oos", "n_oos", "n_windows_valid", "n_windows_tested", "is_robust"),
                 F.struct("is_robust", "precision_oos", "n_oos", "rule_id")).alias("_b"))
    out = cells.join(top, cell, "left").select(*cell, "n_sessions", "n_positive", F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_robust", F.lit(0)).alias("n_robust"), "_b.*")
    status = F.when(truth(F.col("is_robust")) & (F.col("precision_oos") >= good), "green").when(F.col("precision_oos") >= fair, "yellow").otherwise("red")
    return out.withColumn("status", status)


def common_features(rules: DataFrame, min_groups: int | None = None, top: int = 10, *, by="entry", within=()) -> DataFrame:
    """Features of the ``top`` ranked rules per group with the number of rules and groups they occur in; those of all groups (or
    of at least ``min_groups``) are marked. ``rules`` carries a ``rank`` within its group; ``within`` (such as the symbol) keeps searches apart."""
    within = keys(within) if within else []
    used = rules.filter(F.col("rank") <= top).select(*within, by, "rule_id", F.explode("features").alias("feature"))
    out = used.groupBy(*within, "feature").agg(F.count(F.lit(1)).alias("n_rules"), F.count_distinct(by).alias("n_groups"))
    if min_groups is not None:
        return out.withColumn("is_common", F.col("n_groups") >= min_groups)
    if not within:
        return out.withColumn("is_common", F.col("n_groups") >= rules.agg(F.count_distinct(by).alias("n")).scalar())
    all_groups = rules.groupBy(*within).agg(F.count_distinct(by).alias("_all"))
    return out.join(all_groups, within).withColumn("is_common", F.col("n_groups") >= F.col("_all")).drop("_all")


def rule_report(hits: DataFrame, sessions: DataFrame, *, rule="rule_id", d="d", amplitude="y_amp", by=()) -> DataFrame:
    """Per rule and year (null for the total) occurrences, positives and precision, with in/out-of-sample counts and the mean and 90 %
    quantile of the amplitude of the positives. ``hits`` holds (rule, d)."""
    group = [*(keys(by) if by else []), rule]
    rows = hits.join(sessions, [*group[:-1], d]).withColumn("year", F.year(d))
    amp = F.when(F.col("y"), F.col(amplitude))
    out = rows.groupingSets([[*map(F.col, group), F.col("year")], [*map(F.col, group)]], *group, "year").agg(
        F.count(F.lit(1)).alias("n"), count_where("y").alias("n_hit"), count_where("in_sample").alias("n_is"), F.avg(amp).alias("mean_amp_hit"), F.percentile(amp, F.lit(0.9)).alias("p90_amp_hit"))
    return out.withColumns({"n_oos": F.col("n") - F.col("n_is"), "precision": ratio("n_hit", "n") * 100.0})


def rule_holdout(rules: DataFrame, features: DataFrame, sessions: DataFrame, year: int, min_precision: float = 90.0, min_n: int = 2, *, d="d", by=()) -> DataFrame:
    """I16: saved rules measured again on the out-of-sample sessions of one year: triggers, precision and the change from the saved one."""
    chosen = rules.filter(F.col("precision_oos") >= min_precision)
    group = [*(keys(by) if by else []), "rule_id"]
    held = rule_dates(chosen, features, sessions, d=d, by=by).join(sessions.filter((F.year(d) == year) & ~F.col("in_sample")).select(*group[:-1], d, "y"), [*group[:-1], d])
    out = held.groupBy(*group).agg(F.count(F.lit(1)).alias("n_trigger"), (F.avg(F.col("y").cast("double")) * 100.0).alias("precision_year"))
    out = out.filter(F.col("n_trigger") >= min_n).join(chosen.select(*group, "precision_oos"), group)
    return out.withColumn("delta", F.col("precision_year") - F.col("precision_oos"))


def threshold_sensitivity(features: DataFrame, sessions: DataFrame, percentiles=tuple(range(10, 91, 5)), min_oos: int = 5, margin: float = 0.95, *, d="d", by=()) -> DataFrame:
    """Out-of-sample precision and lift per percentile (the better direction), the optimum, and the lowest and highest percentile
    within the margin of the optimum's precision."""
    group = keys(by) if by else []
    counts = univariate_counts(features, sessions, percentiles, 1, d=d, by=by).filter(F.col("n_oos") >= min_oos)
    base = sessions.filter(~F.col("in_sample")).groupBy(*group).agg((F.avg(F.col("y").cast("double")) * 100.0).alias("baseline"))
    curve = counts.withColumn("precision_oos", ratio("h_oos", "n_oos") * 100.0)
    curve = curve.join(base, group) if group else curve.withColumn("baseline", base.scalar())
    curve = curve.withColumn("lift", F.col("precision_oos") - F.col("baseline"))
    better = Window.partitionBy(*group, "feature", "percentile").orderBy(F.col("lift").desc(), "direction")
    curve = curve.withColumn("_r", F.row_number().over(better)).filter("_r = 1")
    per = Window.partitionBy(*group, "feature")
    top = F.max(F.struct(F.col("lift"), -F.col("percentile"), F.col("precision_oos").alias("p"))).over(per)
    curve = curve.withColumn("_top", top)
    near = F.when(F.col("precision_oos") >= F.col("_top.p") * margin, F.col("percentile"))
    return curve.withColumns({"is_optimal": (F.col("lift") == F.col("_top.lift")) & (F.col("percentile") == -F.col("_top.col2")),
                              "margin_low": F.min(near).over(per), "margin_high": F.max(near).over(per)}).select(
        *group, "feature", "percentile", "direction", "threshold", "n_oos", "precision_oos", "lift", "baseline", "is_optimal", "margin_low", "margin_high")


def active_rules(rules: DataFrame, features: DataFrame, top: int | None = None, min_precision: float = 90.0, min_n: int = 6, asof=None, *, d="d", source="source", by=()) -> DataFrame:
    """Saved rules (precise, frequent enough, not suspect; ``top``: only the best per source) whose conditions all hold on the newest
    session (or the newest up to ``asof``). A condition on a missing feature fails."""
    good = rules.filter((F.col("precision_oos") >= min_precision) & (F.col("n_oos") >= min_n) & ~F.col("leakage_suspect"))
    source = [*(keys(by) if by else []), source]
    order = Window.partitionBy(*source).orderBy((F.col("precision_oos") == 100.0).desc(), F.col("is_robust").desc(), F.col("precision_oos").desc(), F.col("n_oos").desc(), "rule_id")
    if top is not None:
        good = good.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    rows = features if asof is None else features.filter(F.col(d) <= F.lit(asof).cast("date"))
    newest = rows.agg(F.max(d).alias("m")).scalar()
    now = rows.filter(F.col(d) == newest).select("feature", d, "value")
    lines = good.select(*source, "rule_id", "precision_oos", "n_oos", F.inline("conditions")).join(now, "feature", "left")
    met = F.when(F.col("direction") == "above", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    out = lines.groupBy(*source, "rule_id").agg(F.bool_and(truth(met)).alias("_ok"), F.max(d).alias(d), F.max("precision_oos").alias("precision_oos"), F.max("n_oos").alias("n_oos"))
    return out.filter("_ok").drop("_ok")
