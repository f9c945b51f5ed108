"""Results that are kept: batches count once, failures are tried again, attempts without a commit are not read."""

from pyspark.sql import functions as F

from lecturelab.operators import resultstore
from lecturelab.session import scratch_path


def test_batches_count_once(spark):
    path = scratch_path(spark, "store")
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("a", "one"), ("c", "bad")], "key string, prompt string")

    def answer(prompt):
        if prompt == "bad":
            raise ValueError(prompt)
        return prompt.upper()

    assert resultstore.stored_results(spark, path).count() == 0
    got = [(r["key"], r["result"]) for r in resultstore.answer_once(rows, answer, path).collect()]
    assert sorted(got) == [("a", "ONE"), ("a", "ONE"), ("b", "TWO"), ("c", None)]
    # a second run asks only for what failed; an answer given now would differ
    again = resultstore.answer_once(rows, lambda p: f"{p}!", path)
    assert {(r["key"], r["result"]) for r in again.collect()} == {("a", "ONE"), ("b", "TWO"), ("c", "bad!")}


def test_repeated_and_lost_attempts(spark):
    path = scratch_path(spark, "store")
    first = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, result string")
    name = resultstore.batch_name(first)
    assert name == resultstore.batch_name(first.orderBy(F.desc("key"))) != resultstore.batch_name(first.limit(1))
    assert resultstore.append_results(first, path, name) and not resultstore.append_results(first.withColumn("result", F.lit("x")), path, name)
    # an attempt that wrote its rows and was lost before its commit
    spark.createDataFrame([("a", "9", "lost"), ("z", "9", "lost")], "key string, result string, attempt string").write.mode("append").parquet(f"{path}/rows")
    assert sorted(map(tuple, resultstore.stored_results(spark, path).collect())) == [("a", "1"), ("b", "2")]
    assert resultstore.append_results(spark.createDataFrame([("b", "7"), ("c", "3")], "key string, result string"), path, "other")
    got = dict(map(tuple, resultstore.stored_results(spark, path).collect()))
    assert got.keys() == {"a", "b", "c"} and got["b"] in ("2", "7")
