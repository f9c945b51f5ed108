"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelab.session import materialise, scratch_path, shared_dir

__all__ = ["GAP", "SPACE", "drop_path", "materialise", "n_words", "scratch_path", "shared_dir", "table", "text_or_empty", "where_computed", "words"]

SPACE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order; null text has none."""
    return F.array_remove(F.split(text_or_empty(text), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """`df.where(condition)` for a costly computed condition: it stays where it is computed.

    A filter is otherwise pushed below the projections that lead to it, each name replaced by its expression, and
    what was computed once in steps is computed again at every mention. A projection that numbers rows holds it up.
    """
    return df.withColumn("_place", F.monotonically_increasing_id()).where(condition & (F.col("_place") >= 0)).drop("_place")


def drop_path(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove tables this library wrote to the shared folder and no plan reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
