"""Queries of models (K), table operations (L) and streaming (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import candles as C
from ..operators import models as M
from ..operators import rules as R
from ..operators import series as S
from ..operators import tables as T
from ..operators import trees as H
from ..sources.shared import shared_dir
from ..streaming import jobs
from .inputs import BARS, CALENDAR, INTRADAY, MARKET, VIX, bars, calendar, market, table, vix
from .registry import query
from .rules_q import BASE as RULE_BASE
from .rules_q import THR, UHITS, metrics, prepared
from .candles_q import STRICT, WIDE
from .series_q import RETURNS


def model_inputs(spark, sf):
    """Features of the rule search, and the sessions of every symbol with y_amp and a three-class y_cat."""
    x, s = prepared(spark, sf)
    return x, s.withColumn("y_cat", F.when(F.col("y_amp") >= 60, 2).when(F.col("y_amp") <= 35, 0).otherwise(1))


SMALL = {"forest": {"trees": 10, "depth": 3}, "boosted": {"rounds": 4, "depth": 2}}
TINY = {"forest": {"trees": 2, "depth": 1}}


@query("K1_chrono_split", "d:s session_no:i n_sessions:i in_sample:b",
       "SELECT d, row_number() OVER (ORDER BY d) AS session_no, count(*) OVER () AS n_sessions, row_number() OVER (ORDER BY d) <= floor(count(*) OVER () * CAST(0.7 AS DOUBLE)) AS in_sample FROM vix", [VIX])
def k1(spark, sf):
    return M.chrono_split(vix(spark, sf))


@query("K2_train_amplitude", "symbol learner acc_is:f acc_oos:f mae:f n_train:i n_test:i cv_mean:f cv_std:f is_best:b")
def k2(spark, sf):
    return H.amplitude_metrics(H.fit(*model_inputs(spark, sf), folds=3, options=SMALL))


MROWS = "mrow AS (SELECT symbol, d, CASE WHEN amp >= 60 THEN 2 WHEN amp <= 35 THEN 0 ELSE 1 END AS cat, ins, rn FROM ses WHERE d IN (SELECT d FROM xd))"


@query("K2_stump", "symbol feature percentile:i n_below:i n_above:i gain:f",
       """SELECT symbol, feature, pct AS percentile, lw AS n_below, rw AS n_above, gain FROM (SELECT *, r0 * r0 / rw + r1 * r1 / rw + r2 * r2 / rw + (s0 - r0) * (s0 - r0) / lw + (s1 - r1) * (s1 - r1) / lw + (s2 - r2) * (s2 - r2) / lw - s0 * s0 / w - s1 * s1 / w - s2 * s2 / w AS gain FROM (
            SELECT m.symbol, x.feature, t.pct, CAST(count(*) AS DOUBLE) AS w, CAST(count(*) FILTER (WHERE value <= t) AS DOUBLE) AS lw, CAST(count(*) FILTER (WHERE value > t) AS DOUBLE) AS rw,
              CAST(count(*) FILTER (WHERE cat = 0) AS DOUBLE) AS s0, CAST(count(*) FILTER (WHERE cat = 1) AS DOUBLE) AS s1, CAST(count(*) FILTER (WHERE cat = 2) AS DOUBLE) AS s2,
              CAST(count(*) FILTER (WHERE value > t AND cat = 0) AS DOUBLE) AS r0, CAST(count(*) FILTER (WHERE value > t AND cat = 1) AS DOUBLE) AS r1, CAST(count(*) FILTER (WHERE value > t AND cat = 2) AS DOUBLE) AS r2
            FROM mrow AS m JOIN xd AS x ON m.d = x.d JOIN thr AS t ON t.symbol = m.symbol AND t.feature = x.feature WHERE ins GROUP BY m.symbol, x.feature, t.pct) AS a WHERE lw >= 5 AND rw >= 5) AS b
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(gain, 9) DESC, feature, pct) = 1""", [*RULE_BASE, THR, MROWS])
def k2_stump(spark, sf):
    """The tree of depth one that every learner of K2 begins with."""
    return H.stump(*model_inputs(spark, sf))


@query("K2_observed_classes", "symbol category:i n:i", "SELECT symbol, cat AS category, count(*) AS n FROM mrow WHERE NOT ins GROUP BY symbol, cat", [*RULE_BASE, MROWS])
def k2_classes(spark, sf):
    """The observed classes out of sample that the models are measured on."""
    models = H.fit(*model_inputs(spark, sf), tasks=("class",), learners=("forest",), options=TINY)
    return H.class_distributions(models).filter("model = 'observed'")


@query("K2_split_sizes", "symbol n_train:i n_test:i", "SELECT symbol, count(*) FILTER (WHERE ins) AS n_train, count(*) FILTER (WHERE NOT ins) AS n_test FROM mrow GROUP BY symbol", [*RULE_BASE, MROWS])
def k2_sizes(spark, sf):
    return H.amplitude_metrics(H.fit(*model_inputs(spark, sf), tasks=("class",), learners=("forest",), options=TINY))


@query("K4_fold_rows", "symbol fold:i n_train:i n_test:i",
       """SELECT b.symbol, k + 1 AS fold, count(*) FILTER (WHERE rn <= first + k * size) AS n_train, count(*) FILTER (WHERE rn > first + k * size AND rn <= first + (k + 1) * size) AS n_test
          FROM (SELECT symbol, CAST(n // 4 AS BIGINT) AS size, CAST(n - 3 * (n // 4) AS BIGINT) AS first FROM (SELECT symbol, count(*) AS n FROM mrow WHERE ins GROUP BY symbol) AS a) AS b
          CROSS JOIN (VALUES (0), (1), (2)) AS q(k) JOIN mrow AS m ON m.symbol = b.symbol AND m.ins GROUP BY b.symbol, k""", [*RULE_BASE, MROWS])
def k4_folds(spark, sf):
    """The sessions of each expanding fold of K2, K4 and K6."""
    rows = H.fold_sessions(model_inputs(spark, sf)[1], 3, by=["symbol"]).filter("fold > 0")
    return rows.groupBy("symbol", "fold").agg(F.count_if("train").alias("n_train"), F.count_if("test").alias("n_test"))


@query("K3_score_latest", "symbol d:s category:i amplitude:f")
def k3(spark, sf):
    models = H.fit(*model_inputs(spark, sf), options=SMALL)
    return H.score_newest(models, H.amplitude_metrics(models))


@query("K3_newest_sessions", "symbol d:s", "SELECT symbol, max(d) AS d FROM mrow GROUP BY symbol", [*RULE_BASE, MROWS])
def k3_days(spark, sf):
    """The sessions that K3 scores."""
    models = H.fit(*model_inputs(spark, sf), learners=("forest",), options=TINY)
    return H.score_newest(models, H.amplitude_metrics(models))


@query("K4_select_features", "symbol feature position:i importance:f")
def k4(spark, sf):
    x, s = model_inputs(spark, sf)
    return H.select_features(H.fit(x, s, tasks=("class",), folds=3, learners=("forest",), options=SMALL), x, s)


@query("K5_top_features", "symbol feature importance:f position:i")
def k5(spark, sf):
    return H.top_features(H.fit(*model_inputs(spark, sf), tasks=("strong",), learners=("forest",), options=SMALL))


@query("K5_correlation_ranking", "symbol feature corr:f abs_corr:f",
       "SELECT symbol, x.feature, corr(value, CAST(y AS INT)) AS corr, abs(corr(value, CAST(y AS INT))) AS abs_corr FROM xd AS x JOIN ses AS s ON x.d = s.d WHERE ins GROUP BY symbol, x.feature", RULE_BASE)
def k5_corr(spark, sf):
    return M.correlation_ranking(*prepared(spark, sf), by=["symbol"])


@query("K6_binary_strong_classifier", "symbol learner threshold:f n_oos:i precision:f per_quarter:f is_best:b")
def k6(spark, sf):
    """The curves of all learners; the best one has the highest precision at .70."""
    return H.strong_classifier(H.fit(*model_inputs(spark, sf), tasks=("strong",), folds=3, options=SMALL))[0]


@query("L1_top_k", "symbol d:s var_pct:f", "SELECT symbol, d, var_pct FROM ret WHERE var_pct IS NOT NULL ORDER BY var_pct DESC, symbol, d LIMIT 25", [BARS, RETURNS])
def l1(spark, sf):
    return T.top_k(S.returns(bars(spark, sf)).filter("var_pct IS NOT NULL"), [F.col("var_pct").desc(), "symbol", "d"], 25)


@query("L2_top_k_per_group", "symbol year:i d:s var_pct:f rank:i",
       "SELECT symbol, year, d, var_pct, row_number() OVER (PARTITION BY symbol, year ORDER BY var_pct DESC, d) AS rank FROM ret WHERE var_pct IS NOT NULL QUALIFY rank <= 3", [BARS, RETURNS])
def l2(spark, sf):
    return T.top_k_per_group(S.returns(bars(spark, sf)).filter("var_pct IS NOT NULL"), ["symbol", "year"], [F.col("var_pct").desc(), "d"], 3)


@query("L3_union_tables", "bucket n:i mean:f", """SELECT 'dow ' || dow AS bucket, count(*) AS n, avg(var_pct) AS mean FROM ret GROUP BY dow UNION ALL SELECT 'month ' || month, count(*), avg(var_pct) FROM ret GROUP BY month""", [BARS, RETURNS])
def l3(spark, sf):
    r = S.returns(bars(spark, sf))
    parts = [r.groupBy(F.concat(F.lit(f"{c} "), F.col(c).cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("var_pct").alias("mean")) for c in ("dow", "month")]
    return T.union_tables(*parts)


@query("L4_date_sets", "d:s", "SELECT d FROM vix WHERE close > 20 INTERSECT SELECT d FROM market WHERE series = '1-URGENT' EXCEPT SELECT d FROM market WHERE series = '5-LOW'", [VIX, MARKET])
def l4(spark, sf):
    m = market(spark, sf)
    both = T.date_intersection(vix(spark, sf).filter("close > 20").select("d"), m.filter("series = '1-URGENT'").select("d"))
    return T.date_difference(both, m.filter("series = '5-LOW'").select("d"))


@query("L5_distinct_rows", "event impact n:i", "SELECT event, impact, count(*) AS n FROM (SELECT DISTINCT event, impact, year(d) AS y FROM calendar) AS c GROUP BY event, impact", [CALENDAR])
def l5(spark, sf):
    rows = T.distinct_rows(calendar(spark, sf).select("event", "impact", F.year("d").alias("y")))
    return rows.groupBy("event", "impact").agg(F.count(F.lit(1)).alias("n"))


@query("L6_text", "plain slug has_rate:b n:i",
       """SELECT strip_accents(lower('Décision ' || event)) AS plain, regexp_replace(regexp_replace(strip_accents(lower('Décision ' || event)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, lower(event) LIKE '%rate%' AS has_rate, count(*) AS n
          FROM calendar GROUP BY event""", [CALENDAR])
def l6(spark, sf):
    text = F.concat(F.lit("Décision "), "event")
    return calendar(spark, sf).groupBy(K.plain_text(text).alias("plain"), K.slug(text).alias("slug"), K.contains_any("event", ["RATE"]).alias("has_rate")).agg(F.count(F.lit(1)).alias("n"))


@query("L7_dates", "year:i quarter:i month:i weekday:i iso_year:i iso_week:i month_start:s n:i",
       """SELECT year(d) AS year, quarter(d) AS quarter, month(d) AS month, isodow(d) - 1 AS weekday, isoyear(d) AS iso_year, week(d) AS iso_week, CAST(date_trunc('month', d) AS DATE) AS month_start, count(*) AS n FROM bars GROUP BY ALL""", [BARS])
def l7(spark, sf):
    d = F.col("d")
    return bars(spark, sf).groupBy(F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.weekday(d).alias("weekday"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"),
                                   F.weekofyear(d).alias("iso_week"), F.trunc(d, "month").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))


@query("L8_math", "symbol d:s move:i size:f clipped:f whole:i up:i sigmoid:f log_size:f",
       """SELECT symbol, d, sign(var_pct) AS move, abs(var_pct) AS size, greatest(least(var_pct, 100), -100) AS clipped, floor(var_pct) AS whole, ceil(var_pct) AS up, 1 / (1 + exp(-var_pct / 100)) AS sigmoid, ln(1 + abs(var_pct)) AS log_size
          FROM ret WHERE var_pct IS NOT NULL""", [BARS, RETURNS])
def l8(spark, sf):
    v = F.col("var_pct")
    return S.returns(bars(spark, sf)).filter(v.isNotNull()).select("symbol", "d", F.signum(v).alias("move"), F.abs(v).alias("size"), F.greatest(F.least(v, F.lit(100.0)), F.lit(-100.0)).alias("clipped"), F.floor(v).alias("whole"),
                                                                   F.ceil(v).alias("up"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-v / 100))).alias("sigmoid"), F.log1p(F.abs(v)).alias("log_size"))


@query("L9_arrays", "symbol year:i n:i first_d:s top:f total:f", "SELECT symbol, year, count(*) AS n, min(d) AS first_d, max(var_pct) AS top, sum(var_pct) AS total FROM ret WHERE var_pct > 50 GROUP BY symbol, year", [BARS, RETURNS])
def l9(spark, sf):
    r = S.returns(bars(spark, sf)).filter("var_pct > 50")
    packed = r.groupBy("symbol", "year").agg(F.array_sort(F.collect_list(F.struct("d", "var_pct"))).alias("rows"))
    values = F.transform("rows", lambda x: x["var_pct"])
    return packed.select("symbol", "year", F.size("rows").alias("n"), F.col("rows")[0]["d"].alias("first_d"), F.array_max(values).alias("top"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("L10_rule_json", "feature direction percentile:i threshold:f n_is:i precision_oos:f",
       "SELECT h.feature, h.dir AS direction, h.pct AS percentile, h.t AS threshold, m.n_is, m.p_oos AS precision_oos FROM met AS m JOIN (SELECT DISTINCT symbol, rule_id, feature, dir, pct, t FROM hits) AS h ON m.symbol = h.symbol AND m.rule_id = h.rule_id WHERE n_is >= 15 AND n_oos >= 6 AND NOT leak AND p_oos >= 55",
       [*RULE_BASE, THR, UHITS, metrics(55)])
def l10(spark, sf):
    rules = R.univariate_rules(*prepared(spark, sf), min_precision=55.0, by=["symbol"])
    path = shared_dir(spark, "rules-json")
    T.rules_to_json(rules.withColumns({"type": F.col("kind"), "operator": F.col("op")}), ["type", "features", "operator", "conditions", "n_is", "n_oos", "precision_is", "precision_oos"]).write.text(path)
    back = T.rules_from_json(spark.read.text(path))
    return back.select(F.inline("conditions"), "n_is", "precision_oos")


@query("L11_user_condition", "symbol d:s close:f", "SELECT symbol, d, close FROM bars WHERE high - low > close AND volume > 100", [BARS])
def l11(spark, sf):
    return T.where(T.where(bars(spark, sf), lambda df: df["high"] - df["low"] > df["close"]), "volume > 100")


@query("L12_rollup", "symbol year:i n:i mean:f", "SELECT symbol, year, count(*) AS n, avg(var_pct) AS mean FROM ret GROUP BY ROLLUP (symbol, year)", [BARS, RETURNS])
def l12(spark, sf):
    return S.returns(bars(spark, sf)).rollup("symbol", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("var_pct").alias("mean"))


@query("M1_stream_bars", "symbol ts:s open:f high:f low:f close:f volume:f",
       "SELECT symbol, ts, open, high, low, close, volume FROM intraday WHERE ts + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE", [INTRADAY()])
def m1(spark, sf):
    """The event table as a stream, processed to the end; bars whose window the watermark has closed."""
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    live = source.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))
    path = shared_dir(spark, "live-bars")
    jobs.run_available(jobs.stream_bars(live, "60 minutes", "30 minutes", order="seq"), f"{path}/bars", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/bars")


@query("M2_stream_scan", "symbol d:s close:f var_j:f vol_ratio:f body_ratio:f",
       "SELECT symbol, d, close, var_j, vr AS vol_ratio, br AS body_ratio FROM strict WHERE d >= DATE '2000-01-01'", [BARS, "earnings AS (SELECT 'none' AS symbol, DATE '1900-01-01' AS d)", WIDE, STRICT])
def m2(spark, sf):
    """Bars from 2000 on arrive as a stream beside the stored earlier ones; the scan is the strict engulfing signal."""
    base = shared_dir(spark, "scan")
    b = bars(spark, sf)
    b.filter("d < '2000-01-01'").write.parquet(f"{base}/history/batch=base")
    # two micro-batches hold the same days and different symbols
    late = b.filter("d >= '2000-01-01'")
    late.filter("symbol < 'N'").coalesce(1).write.parquet(f"{base}/incoming")
    late.filter("symbol >= 'N'").coalesce(1).write.mode("append").parquet(f"{base}/incoming")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/incoming")
    jobs.stream_scan(stream, f"{base}/history", C.engulfing_strict, f"{base}/signals", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/signals")
