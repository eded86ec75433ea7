"""Sorts, limits, set operations and rule files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import truth
from ..functions.windows import keys


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """L1: the first k rows; ``order`` should end with a unique tie-break."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by, order, k: int) -> DataFrame:
    """L2: the first k rows of each group with their rank; the limit applies before the shuffle as well."""
    w = Window.partitionBy(*keys(by)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def union_tables(*tables: DataFrame) -> DataFrame:
    """L3: union by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def date_intersection(*date_sets: DataFrame, on="d") -> DataFrame:
    """L4: dates in every set."""
    return reduce(lambda a, b: a.join(b, keys(on), "left_semi"), date_sets).select(*keys(on)).distinct()


def date_difference(dates: DataFrame, *others: DataFrame, on="d") -> DataFrame:
    """L4: dates of the first set in none of the others."""
    return reduce(lambda a, b: a.join(b, keys(on), "left_anti"), others, dates).select(*keys(on)).distinct()


def distinct_rows(df: DataFrame, by=None) -> DataFrame:
    """One row per key (or per whole row)."""
    return df.dropDuplicates(keys(by)) if by else df.distinct()


def where(df: DataFrame, predicate) -> DataFrame:
    """An arbitrary user condition: a column, SQL text, or a function of the frame giving a column."""
    if callable(predicate) and not isinstance(predicate, Column):
        predicate = predicate(df)
    return df.filter(predicate) if isinstance(predicate, str) else df.filter(truth(predicate))


RULE = ("type: string, features: array<string>, operator: string, "
        "conditions: array<struct<feature: string, direction: string, threshold: double, percentile: int>>, n_is: int, n_oos: int, precision_is: double, "
        "precision_oos: double, leakage_suspect: boolean, is_robust: boolean, per_quarter_oos: double, oos_dates: array<string>")


def rules_to_json(rules: DataFrame, columns) -> DataFrame:
    """One JSON text per rule."""
    return rules.select(F.to_json(F.struct(*columns)).alias("value"))


def rules_from_json(text: DataFrame, column="value") -> DataFrame:
    """Rules from JSON text rows."""
    return text.select(F.from_json(column, f"struct<{RULE}>").alias("r")).select("r.*")


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """Rule result files (one document with a list of rules each) as one row per rule with its source."""
    raw = spark.read.json(path, schema=f"entry_point string, target string, all_patterns array<struct<{RULE}>>", multiLine=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json", 1)
    return raw.select(name.alias("source"), "entry_point", "target", F.inline("all_patterns"))
