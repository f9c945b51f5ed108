"""The table of bits that drops windows before the benchmark is joined."""

import random

from pyspark.sql import functions as F

from lecturelab.llm import decontaminate
from lecturelab.llm.common import table

SF = "/root/testdata/sf0.001"


def test_every_hash_passes_and_most_strangers_do_not(spark):
    draw = random.Random(3)
    own = [0, -1, 1, 2**63 - 1, -2**63, *(draw.randrange(-2**63, 2**63) for _ in range(3000))]
    bits = decontaminate.bit_table(spark.createDataFrame([(h,) for h in own + own[:9]], "hash long"))
    rows = [(h, h in set(own)) for h in own + [draw.randrange(-2**63, 2**63) for _ in range(3000)]] + [(None, False)]
    df = spark.createDataFrame(rows, "h long, own boolean")
    passed = df.select("own", decontaminate._passes(F.col("h"), bits).alias("p")).where("p").groupBy("own").count().collect()
    counts = {r["own"]: r["count"] for r in passed}
    assert counts[True] == sum(o for _, o in rows) and counts.get(False, 0) < 30
    empty = decontaminate.bit_table(df.where("false").select(F.col("h").alias("hash")))
    assert df.where(decontaminate._passes(F.col("h"), empty)).count() == 0


def test_the_table_is_mentioned_once_for_each_mask(spark):
    """A task is sent a copy for each mention, and the driver holds and plans them all."""
    index = decontaminate.benchmark_index(table(spark, SF, "benchmark"))
    slim = table(spark, SF, "documents").select(F.col("doc_id").alias("_k"), decontaminate.passage_words(F.col("text")).alias("_w"))
    hits = decontaminate._each(decontaminate._hashes(slim), decontaminate.bit_table(index))
    plan = hits._jdf.queryExecution().optimizedPlan()
    mentions = [line.count("scalar-subquery#") for line in plan.toString().splitlines() if "scalar-subquery#" in line]
    assert 0 < sum(mentions) <= decontaminate.MASKS
