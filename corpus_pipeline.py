"""The corpus pipeline: quality rules, language, near copies, benchmark leaks, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lecturelab.llm import decontaminate, langid, mixing, neardup, quality_rules
from lecturelab.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is known well enough go; the model is learned from this stage's input."""
    return langid.keep(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose SimHash fingerprints link, or whose texts share 80% of their five-word shingles."""
    return neardup.near_only_once(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: doc_id, size, source_size, target, taken. Documents it takes nothing of go."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("language_id", language), ("simhash_neardup", near_copies), ("benchmark_decontamination", leaks), ("mixing", mix)]

#: The language stage learns a model, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
