"""Quality rules with adaptive cutoffs, in DataFrame functions only.

Every document gets a few measures of its whole text. One mergeable quantile sketch per measure, language and source
gives the quartiles of that group; a document outside the fences of its own group is rejected. There is no fixed cutoff
but the two base rules and a least width of the fences.

Nulls and edge cases: a null text counts as empty; an empty text has zero words and fails the base rule; null languages
and sources form groups of their own; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import SPACE, words_column

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: measure -> (expression over the base columns, least distance between the quartiles)
MEASURES = {
    "symbol_ratio": ("n_symbols / greatest(word_chars, 1)", 0.02),
    "word_length": ("word_chars / greatest(n_words, 1)", 1.0),
    "dup_line_ratio": ("n_dup_lines / greatest(n_lines, 1)", 0.1),
}
FENCE = 3.0
MEASURE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", *MEASURES]


def _repeat_words(grams: Column, order: Column) -> Column:
    """Words covered by windows that occur twice or more, given the window hashes and, sorted, (hash, place)."""
    def again(s, k):
        before, after = F.get(order, k - 1)["h"], F.get(order, k + 1)["h"]
        return F.when((s["h"] == before) | (s["h"] == after), s["i"])
    places = F.sort_array(F.filter(F.transform(order, again), lambda p: p.isNotNull()))
    return F.struct(places.alias("places"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base columns and measures; in-row work only, no shuffle."""
    names = docs.columns
    if set(names) & {*MEASURE_COLUMNS, *(f"_{x}" for x in "wlhgop")}:
        raise ValueError("give only the columns that the measures need; quality_filter keeps the others aside")
    keep = [F.col(f"`{c}`") for c in names]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1)))
    a = docs.select(*keep, words_column(t).alias("_w"), lines.alias("_l"),
                    F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"))
    b = a.select(*keep, "n_symbols", F.size("_w").cast("bigint").alias("n_words"),
                 F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
                 F.size("_l").cast("bigint").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
                 F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    gram = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)]))
    base = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    c = b.select(*keep, *base, F.when(F.size("_h") >= WINDOW, gram).alias("_g"))
    d = c.select(*keep, *base, F.when(F.size(F.array_distinct("_g")) < F.size("_g"),
                                      F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_o"))
    e = d.select(*keep, *base, F.when(F.col("_o").isNotNull(), _repeat_words(F.col("_g"), F.col("_o"))["places"]).alias("_p"))
    widths = F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeat = F.coalesce(F.aggregate(widths, F.lit(0).cast("bigint"), lambda x, y: x + y), F.lit(0).cast("bigint"))
    f = e.select(*keep, *base, repeat.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return f.select(*keep, *base, "n_repeat_words", failed.alias("base_failed"), *[F.expr(x).alias(m) for m, (x, _) in MEASURES.items()])


def adaptive_thresholds(rows: DataFrame, by=("lang", "source"), accuracy: int = 10000) -> DataFrame:
    """Fences per group from mergeable quantile sketches: one row per group, `<measure>_low` and `<measure>_high`.

    percentile_approx keeps a sketch of bounded size per task and group and merges the sketches after the shuffle, so
    a group with a third of all rows sends one sketch per task."""
    q = rows.groupBy(*by).agg(*[F.percentile_approx(m, [0.25, 0.75], accuracy).alias(m) for m in MEASURES])
    out = []
    for m, (_, least) in MEASURES.items():
        low, high = F.col(m)[0], F.col(m)[1]
        width = F.greatest(high - low, F.lit(least)) * FENCE
        out += [(low - width).alias(f"{m}_low"), (high + width).alias(f"{m}_high")]
    return q.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *out)


def judged(rows: DataFrame, thresholds: DataFrame, by=("lang", "source")) -> DataFrame:
    """``rows`` with `kept`. The thresholds are one row per language and source; Spark broadcasts them when their file
    is below its own limit and otherwise joins by shuffle."""
    names = rows.columns
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t._by{i}")) for i, c in enumerate(by)]
    inside = ~F.col("r.base_failed")
    for m in MEASURES:
        inside = inside & F.col(f"r.{m}").between(F.col(f"t.{m}_low"), F.col(f"t.{m}_high"))
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return (rows.alias("r").join(thresholds.alias("t"), cond, "left")
            .select(*[F.col(f"r.`{c}`") for c in names], F.coalesce(inside, F.lit(False)).alias("kept")))


def quality_verdicts(docs: DataFrame, key: str = "doc_id", by=("lang", "source")) -> DataFrame:
    """Measures and verdict of every document, without its text. Measures are computed once and written to the shared folder."""
    rows = materialize(measured(docs.select(key, *by, "text")).drop("text"), "quality-measures")
    return judged(rows, materialize(adaptive_thresholds(rows, by), "quality-thresholds"), by)


def quality_filter(docs: DataFrame, by=("lang", "source")) -> DataFrame:
    """The documents that the rules keep, all columns. The measures are computed again beside the text, which so never
    crosses a shuffle."""
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *by, F.col("text"))
    rows = measured(docs.select(*by, "text")).select(*by, *MEASURES)
    return judged(measured(aside), materialize(adaptive_thresholds(rows, by), "quality-thresholds"), by).where("kept").select("_row.*")
