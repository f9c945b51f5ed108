"""Registered queries of this package, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelab.llm import (
    bpe, decontaminate, importance, langid, licenses, mixing, neardup, negatives, preference, quality_knn, quality_rules, url_filter, warc)
from lecturelab.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_quality_rules", quality_rules.oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_simhash_neardup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", neardup.fingerprint_text(found["fp"]).alias("fingerprint"), "component_id")


@query("op3_license_scans", licenses.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_preference_formatting", preference.oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is chosen; rejected is the same with its last answer taken from the next conversation."""
    return preference.format_pairs(preference.with_other_answers(table(spark, sf_dir, "conversations")), F.col("conv_id"), F.col("_side"))


@query("op9_benchmark_decontamination", decontaminate.oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = (
    url_filter.UrlRule("allow", "com"), url_filter.UrlRule("block", "example.com", "/en/"), url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"), url_filter.UrlRule("block", "net", "/fr/"),
)


@query("op6_url_filters", url_filter.oracle(URL_RULES))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull())
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.classify(docs, quality_knn.train(docs, table(spark, sf_dir, "labels")))


@query("op10_warc", warc.oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op11_hard_negatives", negatives.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.col("id") % negatives.ANCHORS == 0
    return negatives.mine(table(spark, sf_dir, "embeddings"), anchor, label=negatives.relabelled())


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    own = bpe.tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), own)


@query("op13_importance_resampling", importance.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
