"""One registered query per operator, with production parameters over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import bpe, divergence, licenses, lm, mil, packing, periods, quality, simhash, substring, tokenfiles, topk, urls
from .common import crc_part, importable, table

QUERIES = {}
SQL = {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = importable(fn)
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


# SQL of words: DuckDB's patterns have the same character class.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP10_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, source, {WORDS} AS w, coalesce(text, '') AS text,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM base)),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(coalesce(j - i, 5), 5)) AS n FROM twice GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id)),
measures AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols / greatest(word_chars, 1) AS m1, word_chars / greatest(n_words, 1) AS m2, n_dup_lines / greatest(n_lines, 1) AS m3
  FROM counts),
ranked AS (
  SELECT lang, source, m1, m2, m3, count(*) OVER g AS n, row_number() OVER (g ORDER BY m1) AS r1,
         row_number() OVER (g ORDER BY m2) AS r2, row_number() OVER (g ORDER BY m3) AS r3
  FROM measures WINDOW g AS (PARTITION BY lang, source)),
quartiles AS (
  SELECT lang, source, {', '.join(f"max(CASE WHEN r{i} = ceil(n / 4) THEN m{i} END) AS a{i}, max(CASE WHEN r{i} = ceil(3 * n / 4) THEN m{i} END) AS b{i}" for i in (1, 2, 3))}
  FROM ranked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(f"m{i} BETWEEN a{i} - 3 * greatest(b{i} - a{i}, {least}) AND b{i} + 3 * greatest(b{i} - a{i}, {least})" for i, least in ((1, 0.02), (2, 1.0), (3, 0.1)))} AS kept
FROM measures m JOIN quartiles q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source"""


@register("op10_quality_rules", OP10_SQL)
def op10(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10"""


@register("op1_exact_top_k", OP1_SQL)
def op1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


@register("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    prints = materialize(simhash.fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    found = simhash.near_duplicate_components(prints)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Fixed values of the contract: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP7_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES {_RULE_ROWS}),
fits AS (SELECT page_id, max_by(h || p, len(h || p)) AS rule, max_by(v, len(h || p)) AS verdict
         FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)"""


@register("op7_url_filters", OP7_SQL)
def op7(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"), [urls.Rule(*x) for x in URL_RULES])


BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@register("op2_bpe_round_trip")
def op2(spark, sf_dir):
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


OP3_SQL = rf"""
WITH base AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM base)),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM grams) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM starts),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM base),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (doc_id)"""


@register("op3_substring_dedup", OP3_SQL)
def op3(spark, sf_dir):
    return substring.kept_words(table(spark, sf_dir, "documents"))


QUALITY_CUT = 0.3


def quality_model(spark, sf_dir):
    """Learned only from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(crc_part("doc_id", 5) != 0)
    return mil.train(table(spark, sf_dir, "documents"), labels)


@register("op4_quality_classifier")
def op4(spark, sf_dir):
    scored = mil.scores(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (crc_part("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@register("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


@register("op5_license_scan")
def op5(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@register("op9_lm_scoring")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, docs.where(crc_part("doc_id", 7) != 2))
    return scored.select("doc_id", (crc_part("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op11_token_files")
def op11(spark, sf_dir):
    return tokenfiles.digest(tokenfiles.store(table(spark, sf_dir, "documents"), BYTE_VOCABULARY), spark)


@register("op12_periodic_runs")
def op12(spark, sf_dir):
    return periods.run_digest(table(spark, sf_dir, "documents"), change=periods.planted)


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(n) + 2 * count(*) AS below FROM dense GROUP BY lang, source),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // CAST(below AS HUGEINT) AS BIGINT) AS p FROM dense JOIN sizes USING (lang, source)),
q AS (SELECT lang, term, CAST(1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // CAST(below AS HUGEINT) AS BIGINT) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term) JOIN (SELECT lang, sum(n) + 2 * count(DISTINCT term) AS below FROM dense GROUP BY lang) USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS v
         FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(v, 0) AS BIGINT) AS value
          FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@register("op13_source_divergence", OP13_SQL)
def op13(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))
