"""Joins whose sides grow with the recordings send neither of them through the driver."""

import __spark_entry__ as entry
from conftest import SF
from lecturelab.operators.ordered import block_of, running
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_are_joined_without_broadcasts(spark):
    """Tables this small would all be broadcast if Spark were left to it, as packed ones of millions of rows are."""
    plan = _plan(entry.queries()["section_prompts"](spark, SF))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_running_values_carry_blocks_without_broadcasts(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"))
    got = running(rows, ["k"], ["i"], block_of(F.col("i"), 10), {"n": ("sum", F.lit(1).cast("long"))})
    assert "Broadcast" not in _plan(got)
    assert {(r["i"], r["n"]) for r in got.collect()} == {(i, i // 7 + 1) for i in range(100)}
