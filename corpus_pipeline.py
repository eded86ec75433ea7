"""A corpus pipeline of five stages over the documents table: classify, filter by rules, dedup, cut repeats, pack.

Each stage takes all that the one before kept; its result is written as Parquet and read again. All but the last return
the columns of documents. Nulls, empty texts, repeated rows and extra columns are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestudy.llm import mil, neardup, packing, quality, substring
from tapestudy.llm.common import importable
from tapestudy.llm.queries import QUALITY_CUT, WORD_VOCABULARY, quality_model
from tapestudy.sources.shared import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least QUALITY_CUT."""
    return mil.keep_good(docs, quality_model(spark, sf_dir), QUALITY_CUT)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source, measured on what came in."""
    return quality.quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies."""
    return neardup.one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; n_chars follows the text."""
    cut = substring.remove_repeated(docs)
    return cut.select(*[F.char_length("text").cast(f.dataType).alias("n_chars") if f.name == "n_chars" else F.col(f"`{f.name}`") for f in docs.schema])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences. Workers that ran the stages before have less memory left for known words."""
    return packing.pack_documents(docs, WORD_VOCABULARY, kept=100_000)


STAGES = [(name, importable(stage)) for name, stage in (
    ("quality classifier", quality_classifier), ("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup), ("best-fit packing", best_fit_packing),
)]

#: SQL has no way to train the classifier or to tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
