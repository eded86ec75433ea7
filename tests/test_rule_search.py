"""Branch and bound of rule combinations and the grid of cells, against brute force on toy frames."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tapestudy.operators import rules as R

DAYS = 260


@pytest.fixture(scope="module")
def market(spark):
    """Six features and two targets over 260 days, as (features, targets, dictionaries)."""
    r = random.Random(9)
    x = {f"f{i}": [round(r.gauss(0, 1), 3) for _ in range(DAYS)] for i in range(6)}
    amp = {s: [round(abs(x["f0"][t] + x["f1"][t] * k + r.gauss(0, 0.4)), 4) for t in range(DAYS)] for s, k in (("A", 1), ("B", -1))}
    level = [round(r.uniform(15, 25), 7) for _ in range(DAYS)]
    day = "date_add(DATE'2020-01-01', {})".format
    features = spark.createDataFrame([(f, t, v) for f, vs in x.items() for t, v in enumerate(vs)], "feature string, t int, value double").selectExpr("feature", f"{day('t')} AS d", "value")
    targets = spark.createDataFrame([(s, t, amp[s][t], level[t]) for s in amp for t in range(DAYS)], "symbol string, t int, y_amp double, level double").selectExpr("symbol", f"{day('t')} AS d", "y_amp", "level")
    return features, targets, x, amp, level


def searched(market, by=("symbol",)):
    features, targets, *_ = market
    sessions = R.materialize(R.rule_sessions(targets, F.expr("y_amp >= 1.0"), by=by))
    bits = R.materialize(R.literal_bits(features, sessions, R.best_threshold_per_feature(features, sessions, range(30, 71, 10), by=by), by=by))
    return sessions, bits, R.session_masks(sessions, by=by)


def literals(market, bits):
    _, _, x, *_ = market
    out = {}
    for r in bits.select("symbol", "feature", "condition").distinct().collect():
        on = [v >= r.condition.threshold if r.condition.direction == "above" else v <= r.condition.threshold for v in x[r.feature]]
        out.setdefault(r.symbol, {})[r.feature] = on
    return out


def measured(on, y, split):
    n_is, n_oos = sum(on[:split]), sum(on[split:])
    h_is, h_oos = (sum(a and b for a, b in zip(on[p], y[p])) for p in (slice(0, split), slice(split, None)))
    return n_is, n_oos, h_is, h_oos


def passes(m, least, min_is=3, min_oos=2):
    n_is, n_oos, h_is, h_oos = m
    return n_is >= min_is and n_oos >= min_oos and h_oos / n_oos * 100.0 >= least and not (h_oos / n_oos * 100.0 - h_is / n_is * 100.0 > 30 and n_oos < 20)


@pytest.mark.parametrize("least", [40.0, 70.0, 95.0])
def test_search_equals_brute_force(market, least):
    sessions, bits, masks = searched(market)
    amp, split = market[3], math.floor(DAYS * 0.7)
    pairs = {(r.symbol, r.rule_id): (r.n_is, r.n_oos) for r in R.combo2_rules(bits, masks, 3, 2, least, by=["symbol"]).collect()}
    wider = {(r.symbol, r.rule_id): (r.n_is, r.n_oos) for r in R.combo_k_rules(None, bits, masks, 5, 3, 2, least, by=["symbol"]).collect()}
    want_pairs, want = {}, {}
    for s, lit in literals(market, bits).items():
        y = [a >= 1.0 for a in amp[s]]
        for k in range(2, 6):
            for names in itertools.combinations(sorted(lit), k):
                both = [all(v) for v in zip(*(lit[f] for f in names))]
                if passes(m := measured(both, y, split), least):
                    (want_pairs if k == 2 else want)[s, " AND ".join(names)] = m[:2]
                if k == 2 and passes(m := measured([any(v) for v in zip(*(lit[f] for f in names))], y, split), least):
                    want_pairs[s, " OR ".join(names)] = m[:2]
    assert pairs == want_pairs
    assert wider == want
    if least == 40.0:
        assert want and want_pairs


def test_levels_cut_below_all_pairs(market):
    _, bits, masks = searched(market)
    for r in R.search_levels(bits, masks, 4, min_precision=90.0, by=["symbol"]).collect():
        assert r.n_supported <= r.n_candidates <= math.comb(6, r.k)
    loose = {(r.symbol, r.k): r.n_candidates for r in R.search_levels(bits, masks, 2, 0, 0, None, by=["symbol"]).collect()}
    assert set(loose.values()) == {15}


def test_needed_hits():
    assert R.needed_hits(6, 82.0) == 5 and R.needed_hits(10, 90.0) == 9 and R.needed_hits(6, None) == 0 and R.needed_hits(50, 58.0) == 29


def test_near_cells_stay_apart(market):
    """Thresholds and caps that round to one name are cells of their own."""
    features, targets, _, amp, level = market
    moves, caps = (0.451, 0.454), (19.1234561, 19.1234562, 30.0)
    sessions = R.materialize(R.grid_sessions(targets, caps, by=["symbol"]))
    cells, masks = R.grid_cells(sessions, moves, 20, 5, by=["symbol"])
    got = {(r.symbol, r.level_cap, r.move_threshold): (r.n_sessions, r.n_positive, r.n_is) for r in cells.collect()}
    want = {}
    for s, c, m in itertools.product(amp, caps, moves):
        inside = [a for a, v in zip(amp[s], level) if v <= c]
        if len(inside) >= 20 and sum(a >= m for a in inside) >= 5:
            want[s, c, m] = (len(inside), sum(a >= m for a in inside), math.floor(len(inside) * 0.7))
    assert got == want and len(want) == 12
    assert masks.select("symbol", "level_cap", "move_threshold").distinct().count() == 12


def test_grid_equals_single_searches(market):
    """Every cell of the grid gives the rules that a search of that cell alone gives."""
    features, targets, *_ = market
    moves, caps = (0.8, 1.2), (20.0, 30.0)
    sessions = R.materialize(R.grid_sessions(targets, caps, by=["symbol"]))
    grid = R.search_grid(features, sessions, moves, 3, min_precision=50.0, good=55.0, fair=50.0, min_per_quarter=0.0, by=["symbol"])
    for cell in grid.filter("symbol = 'A' AND move_threshold = 0.8").collect():
        rows = targets.filter((targets.symbol == cell.symbol) & (targets.level <= cell.level_cap))
        alone = R.rule_sessions(rows, F.expr(f"y_amp >= {cell.move_threshold}"))
        rules = R.search_rules(features, alone, 3, min_precision=50.0, min_per_quarter=None).filter("precision_oos >= 55 AND n_oos >= 6 AND NOT leakage_suspect").collect()
        assert cell.n_good == len(rules) and cell.n_robust == sum(r.is_robust for r in rules)
        if rules:
            best = max(rules, key=lambda r: (r.is_robust, r.precision_oos, r.n_oos, r.rule_id))
            assert (cell.rule_id, cell.precision_oos, cell.n_oos) == (best.rule_id, best.precision_oos, best.n_oos)
