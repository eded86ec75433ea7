"""Queries of rule search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as H
from ..operators import rules as R
from .features_q import ORDER_DAYS
from .inputs import assets, bars, vix
from .registry import query

# the 21 lagged series as dense features over the days of the order table, and the targets of all symbols
XD = """xdays AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM filled WHERE v IS NOT NULL) AS u),
xmed AS (SELECT f.series, count(*) AS k, max(x.n) AS n, median(CASE WHEN x.rn <= floor(x.n * CAST(0.7 AS DOUBLE)) THEN f.v END) AS med FROM filled AS f JOIN xdays AS x ON f.d = x.d WHERE f.v IS NOT NULL GROUP BY f.series),
xd AS (SELECT m.series AS feature, x.d, coalesce(f.v, m.med) AS value FROM xmed AS m CROSS JOIN xdays AS x LEFT JOIN filled AS f ON f.series = m.series AND f.d = x.d WHERE 1 - m.k * 1.0 / m.n <= 0.4)"""
SES = """ses AS (SELECT symbol, d, amp, amp >= 50.0 AS y, rn, n, rn <= floor(n * CAST(0.7 AS DOUBLE)) AS ins, n - floor(n * CAST(0.7 AS DOUBLE)) AS oos_n,
  CASE WHEN n // 9 >= 5 AND (rn - 1) // (n // 9) BETWEEN 1 AND 8 THEN (rn - 1) // (n // 9) END AS win
  FROM (SELECT symbol, d, amp, row_number() OVER (PARTITION BY symbol ORDER BY d) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM (
    SELECT symbol, d, abs((close - open) / open * 100.0) AS amp FROM bars WHERE d IN (SELECT d FROM xdays)) AS a WHERE amp IS NOT NULL) AS b)"""
BASE = [*ORDER_DAYS, XD, SES]
BY = ["symbol"]


def prepared(spark, sf):
    """Features and the sessions of every symbol, each written once: every search step reads them several times."""
    raw = H.raw_lagged_features(assets(spark, sf), vix(spark, sf).select("d"))
    x = R.materialize(H.drop_sparse_and_impute(raw), "features")
    t = H.daily_targets(bars(spark, sf), 50.0, 20.0).join(x.select("d").distinct(), ["d"], "left_semi")
    return x, R.materialize(R.rule_sessions(t, F.col("y_amp") >= 50.0, by=BY), "sessions")


THR = """thr AS (SELECT symbol, feature, unnest([10, 20, 30, 40, 50, 60, 70, 80, 90]) AS pct, unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS t
  FROM xd JOIN ses ON xd.d = ses.d WHERE ins GROUP BY symbol, feature)"""
UHITS = """hits AS (SELECT x.feature || ':' || dir || ':' || pct AS rule_id, x.feature, pct, dir, t, s.* FROM xd AS x JOIN ses AS s ON x.d = s.d JOIN thr ON thr.feature = x.feature AND thr.symbol = s.symbol
  CROSS JOIN (VALUES ('above'), ('below')) AS q(dir) WHERE (dir = 'above' AND value >= t) OR (dir = 'below' AND value <= t))"""


def metrics(minimum, name="met", source="hits"):
    """Precisions are share * 100 in doubles, as the operator computes them: limits are compared with exactly that value."""
    return f"""{name} AS (SELECT c.*, w.tested, w.valid, w.mean_wf, w.std_wf, coalesce(w.valid, 0) >= greatest(2, floor(coalesce(w.tested, 0) * 0.75)) AS robust,
  coalesce(p_oos - p_is > 30 AND n_oos < 20, false) AS leak FROM (
    SELECT symbol, rule_id, count(*) FILTER (WHERE ins) AS n_is, count(*) FILTER (WHERE NOT ins) AS n_oos, CAST(count(*) FILTER (WHERE ins AND y) AS DOUBLE) / nullif(count(*) FILTER (WHERE ins), 0) * 100.0 AS p_is,
      CAST(count(*) FILTER (WHERE NOT ins AND y) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT ins), 0) * 100.0 AS p_oos,
      round(count(*) FILTER (WHERE NOT ins) / greatest(max(oos_n) / 63.0, 1.0), 1) AS per_q FROM {source} GROUP BY symbol, rule_id) AS c
  LEFT JOIN (SELECT symbol, rule_id, count(*) AS tested, count(*) FILTER (WHERE p >= {minimum}) AS valid, avg(p) AS mean_wf, stddev_pop(p) AS std_wf FROM (
    SELECT symbol, rule_id, win, CAST(count(*) FILTER (WHERE y) AS DOUBLE) / count(*) * 100.0 AS p FROM {source} WHERE win IS NOT NULL GROUP BY symbol, rule_id, win HAVING count(*) >= 2) AS a GROUP BY symbol, rule_id) AS w ON c.symbol = w.symbol AND c.rule_id = w.rule_id)"""


COLS = "symbol rule_id n_is:i n_oos:i precision_is:f precision_oos:f leakage_suspect:b per_quarter_oos:f n_windows_tested:i n_windows_valid:i is_robust:b mean_precision_wf:f std_precision_wf:f"
SELECT = """SELECT symbol, rule_id, n_is, n_oos, p_is AS precision_is, p_oos AS precision_oos, leak AS leakage_suspect, per_q AS per_quarter_oos, coalesce(tested, 0) AS n_windows_tested,
          coalesce(valid, 0) AS n_windows_valid, robust AS is_robust, mean_wf AS mean_precision_wf, std_wf AS std_precision_wf FROM {m} WHERE n_is >= 15 AND n_oos >= 6 AND NOT leak AND p_oos >= {p}"""
P1 = 55.0


@query("I6_rule_stats", "symbol rule_id n_is:i n_oos:i precision_is:f precision_oos:f leakage_suspect:b",
       """SELECT symbol, rule_id, n_is, n_oos, p_is AS precision_is, p_oos AS precision_oos, leak AS leakage_suspect FROM met WHERE n_is >= 15 AND n_oos >= 6""",
       [*BASE, "hits AS (SELECT feature || ' high' AS rule_id, s.* FROM xd JOIN ses AS s ON xd.d = s.d WHERE value > 30)", metrics(60)])
def i6(spark, sf):
    x, s = prepared(spark, sf)
    hits = x.filter("value > 30").select(F.concat("feature", F.lit(" high")).alias("rule_id"), "d")
    return R.rule_stats(hits.join(s.select(*BY, "d"), "d"), s, by=BY)


@query("I7_walk_forward", "symbol rule_id n_windows_tested:i n_windows_valid:i is_robust:b mean_precision_wf:f std_precision_wf:f",
       """SELECT symbol, rule_id, coalesce(tested, 0) AS n_windows_tested, coalesce(valid, 0) AS n_windows_valid, robust AS is_robust, mean_wf AS mean_precision_wf, std_wf AS std_precision_wf FROM met""",
       [*BASE, "hits AS (SELECT feature || ' high' AS rule_id, s.* FROM xd JOIN ses AS s ON xd.d = s.d WHERE value > 30)", metrics(60)])
def i7(spark, sf):
    x, s = prepared(spark, sf)
    hits = x.filter("value > 30").select(F.concat("feature", F.lit(" high")).alias("rule_id"), "d")
    return R.walk_forward(hits.join(s.select(*BY, "d"), "d"), s, min_precision=60.0, by=BY)


@query("I8_univariate_rules", f"{COLS} feature direction percentile:i threshold:f",
       f"SELECT a.*, b.feature, b.direction, b.percentile, b.threshold FROM ({SELECT.format(m='met', p=P1)}) AS a JOIN (SELECT DISTINCT symbol, rule_id, feature, dir AS direction, pct AS percentile, t AS threshold FROM hits) AS b ON a.symbol = b.symbol AND a.rule_id = b.rule_id",
       [*BASE, THR, UHITS, metrics(P1)])
def i8(spark, sf):
    return R.univariate_rules(*prepared(spark, sf), min_precision=P1, by=BY)


@query("I8_rule_dates", "symbol rule_id n:i first_d:s last_d:s",
       f"SELECT h.symbol, h.rule_id, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM hits AS h JOIN met AS m ON h.symbol = m.symbol AND h.rule_id = m.rule_id WHERE NOT ins AND n_is >= 15 AND n_oos >= 6 AND NOT leak AND p_oos >= {P1} GROUP BY h.symbol, h.rule_id",
       [*BASE, THR, UHITS, metrics(P1)])
def i8_dates(spark, sf):
    x, s = prepared(spark, sf)
    dates = R.rule_dates(R.univariate_rules(x, s, min_precision=P1, by=BY), x, s, by=BY)
    return dates.groupBy(*BY, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


BEST = """best AS (SELECT symbol, feature, dir, round(t, 4) AS t, pct, p, n FROM (SELECT symbol, feature, dir, pct, any_value(t) AS t, count(*) AS n, CAST(count(*) FILTER (WHERE y) AS DOUBLE) / count(*) * 100.0 AS p FROM hits WHERE ins
  GROUP BY symbol, feature, dir, pct HAVING count(*) >= 15) AS a WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY symbol, feature ORDER BY p DESC, pct, dir) = 1)"""


@query("I9_best_threshold_per_feature", "symbol feature direction threshold:f percentile:i precision_is:f n_is:i",
       "SELECT symbol, feature, dir AS direction, t AS threshold, pct AS percentile, p AS precision_is, n AS n_is FROM best", [*BASE, THR, UHITS, BEST])
def i9(spark, sf):
    return R.best_threshold_per_feature(*prepared(spark, sf), by=BY)


PAIRS = """lit AS (SELECT b.symbol, x.feature, x.d, CASE WHEN dir = 'above' THEN value >= t ELSE value <= t END AS on_ FROM xd AS x JOIN best AS b ON x.feature = b.feature),
phits AS (SELECT a.feature || ' ' || op || ' ' || b.feature AS rule_id, s.* FROM lit AS a JOIN lit AS b ON a.symbol = b.symbol AND a.d = b.d AND a.feature < b.feature JOIN ses AS s ON s.symbol = a.symbol AND s.d = a.d
  CROSS JOIN (VALUES ('AND'), ('OR')) AS q(op) WHERE (op = 'AND' AND a.on_ AND b.on_) OR (op = 'OR' AND (a.on_ OR b.on_)))"""
PAIR_BASE = [*BASE, THR, UHITS, BEST, PAIRS]
P2 = 58.0


def bits_masks(spark, sf):
    x, s = prepared(spark, sf)
    bits = R.literal_bits(x, s, R.best_threshold_per_feature(x, s, by=BY), by=BY)
    return R.materialize(bits, "bits"), R.materialize(R.session_masks(s, by=BY), "masks")


@query("I10_combo2_rules", COLS, SELECT.format(m="met", p=P2), [*PAIR_BASE, metrics(P2, source="phits")])
def i10(spark, sf):
    bits, masks = bits_masks(spark, sf)
    return R.combo2_rules(bits, masks, min_precision=P2, by=BY)


def searched(spark, sf, max_k=5):
    return R.search_rules(*prepared(spark, sf), max_k, min_precision=P2, by=BY)


@query("I11_combo_k_rules", f"{COLS} kind")
def i11(spark, sf):
    bits, masks = bits_masks(spark, sf)
    return R.combo_k_rules(None, bits, masks, min_precision=P2, by=BY)


@query("I11_combo_beam", f"{COLS} kind")
def i11_beam(spark, sf):
    bits, masks = bits_masks(spark, sf)
    pairs = R.materialize(R.combo2_rules(bits, masks, min_precision=P2, by=BY), "combo2")
    return R.combo_k_rules(pairs, bits, masks, min_precision=P2, beam=R.BEAM, by=BY)


def joined_by_and(k):
    """SQL of the sessions on which k conditions hold together, for every combination in order."""
    names = "abcde"[:k]
    rule = " || ' AND ' || ".join(f"{n}.feature" for n in names)
    joins = " ".join(f"JOIN lit AS {n} ON {n}.symbol = {m}.symbol AND {n}.d = {m}.d AND {n}.on_ AND {n}.feature > {m}.feature" for m, n in zip(names, names[1:]))
    return f"SELECT {rule} AS rule_id, {', '.join(f'{n}.feature AS f{i + 1}' for i, n in enumerate(names))}, s.* FROM lit AS a {joins} JOIN ses AS s ON s.symbol = a.symbol AND s.d = a.d WHERE a.on_"


@query("I11_combo3_step", f"{COLS}", SELECT.format(m="met3", p=P2), [*PAIR_BASE, f"thits AS ({joined_by_and(3)})", metrics(P2, "met3", "thits")])
def i11_triples(spark, sf):
    bits, masks = bits_masks(spark, sf)
    return R.combo_k_rules(None, bits, masks, 3, min_precision=P2, by=BY)


@query("I11_combo4_step", f"{COLS} kind", SELECT.format(m="met3", p=P2).replace(" FROM met3", ", 'combo3_AND' AS kind FROM met3") + " UNION ALL " + SELECT.format(m="met4", p=P2).replace(" FROM met4", ", 'combo4_AND' AS kind FROM met4"),
       [*PAIR_BASE, f"thits AS ({joined_by_and(3)})", metrics(P2, "met3", "thits"), f"qhits AS ({joined_by_and(4)})", metrics(P2, "met4", "qhits")])
def i11_fours(spark, sf):
    bits, masks = bits_masks(spark, sf)
    return R.combo_k_rules(None, bits, masks, 4, min_precision=P2, by=BY)


def supported_sql(k):
    """SQL of the combinations of k conditions that go on: enough sessions in and out of sample, and the hits of a passing rule."""
    names = ", ".join(f"f{i + 1}" for i in range(k))
    return (f"SELECT symbol, {names} FROM ({joined_by_and(k)}) AS q GROUP BY symbol, {names} "
            f"HAVING count(*) FILTER (WHERE ins) >= 15 AND count(*) FILTER (WHERE NOT ins) >= 6 AND count(*) FILTER (WHERE NOT ins AND y) >= {R.needed_hits(6, P2)}")


def candidates_sql(k):
    """SQL of the number of candidates of size k: two supported combinations of one less that share all but the last."""
    shared = "".join(f" AND a.f{i + 1} = b.f{i + 1}" for i in range(k - 2))
    return f"SELECT a.symbol, {k} AS k, count(*) AS n FROM sup{k - 1} AS a JOIN sup{k - 1} AS b ON a.symbol = b.symbol{shared} AND a.f{k - 1} < b.f{k - 1} GROUP BY a.symbol"


@query("I11_search_levels", "symbol k:i n_candidates:i n_supported:i",
       "SELECT c.symbol, c.k, c.n AS n_candidates, coalesce(u.n, 0) AS n_supported FROM (" + " UNION ALL ".join(candidates_sql(k) for k in (2, 3, 4)) + ") AS c LEFT JOIN ("
       + " UNION ALL ".join(f"SELECT symbol, {k} AS k, count(*) AS n FROM sup{k} GROUP BY symbol" for k in (2, 3, 4)) + ") AS u ON c.symbol = u.symbol AND c.k = u.k",
       [*PAIR_BASE, *[f"sup{k} AS ({supported_sql(k)})" for k in (1, 2, 3, 4)]])
def i11_levels(spark, sf):
    """How many combinations enter each level of the search."""
    bits, masks = bits_masks(spark, sf)
    return R.search_levels(bits, masks, 4, min_precision=P2, by=BY)


@query("I12_search_rules", f"{COLS} kind actionable:b rank:i")
def i12(spark, sf):
    return searched(spark, sf)


@query("I12_search_pairs", f"{COLS} actionable:b",
       f"""SELECT *, precision_oos >= {P2} AND n_oos >= 6 AND NOT leakage_suspect AND per_quarter_oos >= 3 AS actionable FROM ({SELECT.format(m='met', p=P2)} UNION ALL {SELECT.format(m='meu', p=P2)}) AS u""",
       [*PAIR_BASE, metrics(P2, source="phits"), metrics(P2, "meu")])
def i12_pairs(spark, sf):
    return searched(spark, sf, 2)


# The grid: amplitude of one or two sessions from the open, four moves, four caps of the level at the open.
GRID_BY = ["symbol", "horizon"]
GRID_MOVES, GRID_CAPS = (55.0, 50.0, 45.0, 40.0), (35.0, 30.0, 25.0, 20.0)
GRID_GOOD, GRID_FAIR = 66.0, 60.0
GSES = f"""gses AS (SELECT *, rn <= floor(n * CAST(0.7 AS DOUBLE)) AS ins, n - floor(n * CAST(0.7 AS DOUBLE)) AS oos_n, CASE WHEN n // 9 >= 5 AND (rn - 1) // (n // 9) BETWEEN 1 AND 8 THEN (rn - 1) // (n // 9) END AS win
  FROM (SELECT g.*, cap, row_number() OVER w AS rn, count(*) OVER (PARTITION BY g.symbol, horizon, cap) AS n
    FROM (SELECT a.*, v.open AS level FROM (
      SELECT symbol, d, h AS horizon, abs((CASE WHEN h = 1 THEN close ELSE c2 END - open) / open * 100.0) AS amp
      FROM (SELECT symbol, d, open, close, lead(close) OVER (PARTITION BY symbol ORDER BY d) AS c2 FROM bars) AS r CROSS JOIN (VALUES (1), (2)) AS q(h)) AS a
      JOIN vix AS v ON a.d = v.d WHERE amp IS NOT NULL AND a.d IN (SELECT d FROM xdays)) AS g
    CROSS JOIN (VALUES {', '.join(f'({c})' for c in GRID_CAPS)}) AS c(cap) WHERE level <= cap WINDOW w AS (PARTITION BY g.symbol, horizon, cap ORDER BY g.d)) AS b),
gcell AS (SELECT symbol, horizon, cap, mt, count(*) AS n_sessions, count(*) FILTER (WHERE amp >= mt) AS n_positive, count(*) FILTER (WHERE ins) AS n_is
  FROM gses CROSS JOIN (VALUES {', '.join(f'({m})' for m in GRID_MOVES)}) AS m(mt) GROUP BY symbol, horizon, cap, mt HAVING count(*) >= 30 AND count(*) FILTER (WHERE amp >= mt) >= 20)"""
GCELL = "symbol, horizon, cap, mt"


def grid_counts(name, source, rule):
    """SQL of the counters of rules in every cell from rows (base, win, ins, amp, rule columns, n): hits by move threshold, then by window."""
    return f"""{name}_w AS (SELECT c.symbol, c.horizon, c.cap, c.mt, {rule}, ins, win, any_value(oos_n) AS oos_n, sum(k) AS n, sum(k) FILTER (WHERE amp >= c.mt) AS h
  FROM {source} AS s JOIN gcell AS c ON s.symbol = c.symbol AND s.horizon = c.horizon AND s.cap = c.cap GROUP BY c.symbol, c.horizon, c.cap, c.mt, {rule}, ins, win),
{name} AS (SELECT {GCELL}, {rule}, coalesce(sum(n) FILTER (WHERE ins), 0) AS n_is, coalesce(sum(n) FILTER (WHERE NOT ins), 0) AS n_oos,
    coalesce(sum(h) FILTER (WHERE ins), 0) AS h_is, coalesce(sum(h) FILTER (WHERE NOT ins), 0) AS h_oos, max(oos_n) AS oos_n FROM {name}_w GROUP BY {GCELL}, {rule}),
{name}_v AS (SELECT {GCELL}, {rule}, count(*) AS tested, count(*) FILTER (WHERE coalesce(h, 0) * 1.0 / n * 100.0 >= {P2}) AS valid
  FROM (SELECT {GCELL}, {rule}, win, sum(n) AS n, sum(h) AS h FROM {name}_w WHERE win IS NOT NULL GROUP BY {GCELL}, {rule}, win) AS q WHERE n >= 2 GROUP BY {GCELL}, {rule})"""


def grid_good(name, rule, rule_id):
    """SQL of the rules of a cell that are good enough."""
    on = " AND ".join(f"m.{c} IS NOT DISTINCT FROM v.{c}" for c in f"{GCELL}, {rule}".split(", "))
    cols = ", ".join(f"m.{c}" for c in GCELL.split(", "))
    return f"""SELECT {cols}, {rule_id} AS rule_id, n_oos, p_oos, coalesce(tested, 0) AS tested, coalesce(valid, 0) AS valid, coalesce(valid, 0) >= greatest(2, floor(coalesce(tested, 0) * 0.75)) AS robust
  FROM (SELECT *, CAST(h_is AS DOUBLE) / n_is * 100.0 AS p_is, CAST(h_oos AS DOUBLE) / n_oos * 100.0 AS p_oos FROM {name} WHERE n_is >= 15 AND n_oos >= 6) AS m LEFT JOIN {name}_v AS v ON {on}
  WHERE p_oos >= {GRID_GOOD} AND p_oos >= {P2} AND NOT (p_oos - p_is > 30 AND n_oos < 20) AND round(n_oos / greatest(oos_n / 63.0, 1.0), 1) >= 2"""


GTHR = """gthr AS (SELECT s.symbol, s.horizon, s.cap, feature, unnest([10, 20, 30, 40, 50, 60, 70, 80, 90]) AS pct, unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS t
  FROM xd JOIN gses AS s ON xd.d = s.d WHERE ins GROUP BY s.symbol, s.horizon, s.cap, feature),
ghit AS (SELECT s.symbol, s.horizon, s.cap, s.ins, s.win, s.oos_n, s.amp, x.feature, pct, dir, 1 AS k FROM gses AS s JOIN xd AS x ON x.d = s.d
  JOIN gthr AS t ON t.symbol = s.symbol AND t.horizon = s.horizon AND t.cap = s.cap AND t.feature = x.feature CROSS JOIN (VALUES ('above'), ('below')) AS q(dir)
  WHERE (dir = 'above' AND value >= t) OR (dir = 'below' AND value <= t))"""
GBEST = f"""gbest AS (SELECT {GCELL}, b.feature, dir, round(t, 4) AS t FROM (SELECT *, CAST(h_is AS DOUBLE) / n_is * 100.0 AS p FROM gone WHERE n_is >= 15) AS b JOIN gthr AS r USING (symbol, horizon, cap, feature, pct)
  WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY {GCELL}, b.feature ORDER BY p DESC, pct, dir) = 1),
glit AS (SELECT b.symbol, b.horizon, b.cap, b.mt, b.feature, x.d, CASE WHEN dir = 'above' THEN value >= t ELSE value <= t END AS on_ FROM gbest AS b JOIN xd AS x ON x.feature = b.feature),
gpair AS (SELECT a.symbol, a.horizon, a.cap, a.mt, a.feature AS fa, b.feature AS fb, op, s.ins, s.win, s.oos_n, s.amp, 1 AS k
  FROM glit AS a JOIN glit AS b ON a.symbol = b.symbol AND a.horizon = b.horizon AND a.cap = b.cap AND a.mt = b.mt AND a.d = b.d AND a.feature < b.feature
  JOIN gses AS s ON s.symbol = a.symbol AND s.horizon = a.horizon AND s.cap = a.cap AND s.d = a.d CROSS JOIN (VALUES ('AND'), ('OR')) AS q(op) WHERE (op = 'AND' AND a.on_ AND b.on_) OR (op = 'OR' AND (a.on_ OR b.on_)))"""
GTWO = grid_counts("gtwo", "gpair", "fa, fb, op").replace("s.cap = c.cap GROUP BY", "s.cap = c.cap AND s.mt = c.mt GROUP BY")


@query("I13_search_grid", "symbol horizon:i level_cap:f move_threshold:f n_sessions:i n_positive:i n_good:i n_robust:i rule_id precision_oos:f n_oos:i n_windows_valid:i n_windows_tested:i status",
       f"""SELECT c.symbol, c.horizon, c.cap AS level_cap, c.mt AS move_threshold, n_sessions, n_positive, coalesce(n_good, 0) AS n_good, coalesce(n_robust, 0) AS n_robust, b.rule_id, b.p_oos AS precision_oos, b.n_oos,
             b.valid AS n_windows_valid, b.tested AS n_windows_tested, CASE WHEN b.robust AND b.p_oos >= {GRID_GOOD} THEN 'green' WHEN b.p_oos >= {GRID_FAIR} THEN 'yellow' ELSE 'red' END AS status
          FROM gcell AS c LEFT JOIN (SELECT {GCELL}, count(*) AS n_good, count(*) FILTER (WHERE robust) AS n_robust FROM good GROUP BY {GCELL}) AS g USING (symbol, horizon, cap, mt)
          LEFT JOIN (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY {GCELL} ORDER BY robust DESC, p_oos DESC, n_oos DESC, rule_id DESC) = 1) AS b USING (symbol, horizon, cap, mt)""",
       [*ORDER_DAYS, XD, GSES, GTHR, grid_counts("gone", "ghit", "feature, pct, dir"), GBEST, GTWO,
        f"good AS ({grid_good('gone', 'feature, pct, dir', chr(39).join(['m.feature || ', ':', ' || m.dir || ', ':', ' || m.pct']))} UNION ALL {grid_good('gtwo', 'fa, fb, op', chr(39).join(['m.fa || ', ' ', ' || m.op || ', ' ', ' || m.fb']))})"])
def i13(spark, sf):
    x, s = grid_inputs(spark, sf)
    return R.search_grid(x, s, GRID_MOVES, min_precision=P2, good=GRID_GOOD, fair=GRID_FAIR, by=GRID_BY)


def grid_inputs(spark, sf):
    """Features, and the sessions of every symbol, horizon and level cap with the move from the open to the close of one or two sessions."""
    from pyspark.sql import Window
    x, _ = prepared(spark, sf)
    b = bars(spark, sf).withColumn("c2", F.lead("close").over(Window.partitionBy("symbol").orderBy("d")))
    ends = F.inline(F.array(F.struct(F.lit(1).alias("horizon"), F.col("close").alias("_end")), F.struct(F.lit(2).alias("horizon"), F.col("c2").alias("_end"))))
    moves = b.select("symbol", "d", "open", ends).select("symbol", "horizon", "d", F.abs((F.col("_end") - F.col("open")) / F.col("open") * 100.0).alias("y_amp")).filter("y_amp IS NOT NULL")
    levels = vix(spark, sf).select("d", F.col("open").alias("level"))
    targets = moves.join(x.select("d").distinct(), ["d"], "left_semi").join(levels, ["d"])
    return x, R.materialize(R.grid_sessions(targets, GRID_CAPS, by=GRID_BY), "grid-sessions")


@query("I13_grid_sessions", "symbol horizon:i level_cap:f move_threshold:f n_sessions:i n_positive:i n_is:i",
       "SELECT symbol, horizon, cap AS level_cap, mt AS move_threshold, n_sessions, n_positive, n_is FROM gcell", [*ORDER_DAYS, XD, GSES])
def i13_cells(spark, sf):
    return R.grid_cells(grid_inputs(spark, sf)[1], GRID_MOVES, by=GRID_BY)[0]


RANKED = f"""ranked AS (SELECT m.symbol, h.feature, h.dir AS entry, m.rule_id, row_number() OVER (PARTITION BY m.symbol, h.dir ORDER BY p_oos DESC, m.rule_id) AS rank
  FROM met AS m JOIN (SELECT DISTINCT symbol, rule_id, feature, dir FROM hits) AS h ON m.symbol = h.symbol AND m.rule_id = h.rule_id WHERE n_is >= 15 AND n_oos >= 6 AND NOT leak AND p_oos >= {P1})"""


@query("I14_common_features", "symbol feature n_rules:i n_groups:i is_common:b",
       "SELECT r.symbol, feature, count(*) AS n_rules, count(DISTINCT entry) AS n_groups, count(DISTINCT entry) >= any_value(e.n) AS is_common FROM ranked AS r JOIN (SELECT symbol, count(DISTINCT entry) AS n FROM ranked GROUP BY symbol) AS e ON r.symbol = e.symbol WHERE rank <= 10 GROUP BY r.symbol, feature",
       [*BASE, THR, UHITS, metrics(P1), RANKED])
def i14(spark, sf):
    from pyspark.sql import Window
    rules = i8(spark, sf).withColumn("entry", F.col("direction"))
    rules = rules.withColumn("rank", F.row_number().over(Window.partitionBy(*BY, "entry").orderBy(F.col("precision_oos").desc(), "rule_id")))
    return R.common_features(rules, within=BY)


@query("I15_rule_report", "symbol rule_id year:i n:i n_hit:i n_is:i n_oos:i precision:f mean_amp_hit:f p90_amp_hit:f",
       """SELECT symbol, rule_id, yr AS year, count(*) AS n, count(*) FILTER (WHERE y) AS n_hit, count(*) FILTER (WHERE ins) AS n_is, count(*) FILTER (WHERE NOT ins) AS n_oos,
          count(*) FILTER (WHERE y) * 100.0 / count(*) AS precision, avg(amp) FILTER (WHERE y) AS mean_amp_hit, quantile_cont(amp, 0.9) FILTER (WHERE y) AS p90_amp_hit
          FROM (SELECT *, year(d) AS yr FROM hits) AS h GROUP BY GROUPING SETS ((symbol, rule_id, yr), (symbol, rule_id))""",
       [*BASE, "hits AS (SELECT feature || ' high' AS rule_id, s.* FROM xd JOIN ses AS s ON xd.d = s.d WHERE value > 30)"])
def i15(spark, sf):
    x, s = prepared(spark, sf)
    hits = x.filter("value > 30").select(F.concat("feature", F.lit(" high")).alias("rule_id"), "d")
    return R.rule_report(hits.join(s.select(*BY, "d"), "d"), s, by=BY)


@query("I16_rule_holdout", "symbol rule_id n_trigger:i precision_year:f precision_oos:f delta:f",
       f"""SELECT h.symbol, h.rule_id, count(*) AS n_trigger, avg(CAST(y AS INT)) * 100.0 AS precision_year, any_value(p_oos) AS precision_oos, avg(CAST(y AS INT)) * 100.0 - any_value(p_oos) AS delta
          FROM hits AS h JOIN met AS m ON h.symbol = m.symbol AND h.rule_id = m.rule_id WHERE NOT ins AND year(d) = 2000 AND n_is >= 15 AND n_oos >= 6 AND NOT leak AND p_oos >= {P1} GROUP BY h.symbol, h.rule_id HAVING count(*) >= 2""",
       [*BASE, THR, UHITS, metrics(P1)])
def i16(spark, sf):
    x, s = prepared(spark, sf)
    return R.rule_holdout(R.univariate_rules(x, s, min_precision=P1, by=BY), x, s, 2000, P1, by=BY)


@query("I17_threshold_sensitivity", "symbol feature percentile:i direction threshold:f9 n_oos:i precision_oos:f lift:f is_optimal:b margin_low:i margin_high:i",
       """SELECT symbol, feature, pct AS percentile, dir AS direction, t AS threshold, n AS n_oos, p AS precision_oos, lift, pct = opt AS is_optimal,
          min(CASE WHEN p >= optp * 0.95 THEN pct END) OVER (PARTITION BY symbol, feature) AS margin_low, max(CASE WHEN p >= optp * 0.95 THEN pct END) OVER (PARTITION BY symbol, feature) AS margin_high
          FROM (SELECT *, first_value(pct) OVER w AS opt, first_value(p) OVER w AS optp FROM (
            SELECT h.symbol, feature, pct, dir, any_value(t) AS t, count(*) AS n, avg(CAST(y AS INT)) * 100.0 AS p, avg(CAST(y AS INT)) * 100.0 - any_value(b.base) AS lift
            FROM hits AS h JOIN (SELECT symbol, avg(CAST(y AS INT)) * 100.0 AS base FROM ses WHERE NOT ins GROUP BY symbol) AS b ON h.symbol = b.symbol
            WHERE NOT ins GROUP BY h.symbol, feature, pct, dir HAVING count(*) >= 5 QUALIFY row_number() OVER (PARTITION BY h.symbol, feature, pct ORDER BY lift DESC, dir) = 1) AS a
            WINDOW w AS (PARTITION BY symbol, feature ORDER BY lift DESC, pct)) AS b""",
       [*BASE, THR.replace("[10, 20, 30, 40, 50, 60, 70, 80, 90]", str(list(range(10, 91, 5)))).replace("[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]", str([p / 100 for p in range(10, 91, 5)])), UHITS])
def i17(spark, sf):
    return R.threshold_sensitivity(*prepared(spark, sf), by=BY)


@query("I18_active_rules", "symbol source rule_id d:s precision_oos:f n_oos:i",
       f"""SELECT r.symbol, source, r.rule_id, x.d, p_oos AS precision_oos, n_oos FROM (SELECT m.*, h.feature, h.dir, h.t, h.dir AS source, row_number() OVER (PARTITION BY m.symbol, h.dir ORDER BY robust DESC, p_oos DESC, n_oos DESC, m.rule_id) AS rn
            FROM met AS m JOIN (SELECT DISTINCT symbol, rule_id, feature, dir, t FROM hits) AS h ON m.symbol = h.symbol AND m.rule_id = h.rule_id WHERE n_is >= 15 AND n_oos >= 6 AND NOT leak AND p_oos >= {P1}) AS r
          JOIN xd AS x ON x.feature = r.feature AND x.d = (SELECT max(d) FROM xd) WHERE ((dir = 'above' AND value >= t) OR (dir = 'below' AND value <= t))""",
       [*BASE, THR, UHITS, metrics(P1)])
def i18(spark, sf):
    x, s = prepared(spark, sf)
    rules = R.univariate_rules(x, s, min_precision=P1, by=BY).withColumn("source", F.col("direction"))
    return R.active_rules(rules, x, min_precision=P1, by=BY)
