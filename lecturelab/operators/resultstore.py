"""Model results that are kept: an append-only store in which a batch counts once, however often it is tried.

A batch is written as rows that carry the name of their attempt, then committed by one manifest file, named after the
batch, that is created only if it is not there yet. Rows of an attempt without a manifest (a lost driver, a repeated
batch) are never read. A key that two different batches committed counts once, the first by name of attempt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelab.operators.prompts import infer, summary_misses

RESULT = "key string, result string"


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """`key, result` of all committed batches, a key once; empty if nothing was committed."""
    manifest, fs = _file(spark, f"{path}/manifest")
    if not fs.exists(manifest):
        return spark.createDataFrame([], RESULT)
    committed = spark.read.text(f"{path}/manifest").select(F.col("value").alias("attempt"))
    rows = spark.read.schema(f"{RESULT}, attempt string").parquet(f"{path}/rows").join(committed, "attempt", "left_semi")
    return rows.groupBy("key").agg(F.min(F.struct("attempt", "result")).alias("r")).select("key", "r.result")


def batch_name(rows: DataFrame) -> str:
    """The same for the same keys in any order."""
    n, a, b = rows.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(key))"), F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}-{(a or 0) % (1 << 64):016x}-{int(b or 0) % (1 << 64):016x}"


def append_results(results: DataFrame, path: str, batch: str) -> bool:
    """Write `key, result` and commit them as `batch`; False if that batch has been committed before."""
    spark = results.sparkSession
    manifest, fs = _file(spark, f"{path}/manifest/{batch}")
    if fs.exists(manifest):
        return False
    attempt = uuid.uuid4().hex
    results.select("key", "result", F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{path}/rows")
    try:
        out = fs.create(manifest, False)
    except Exception:  # another attempt came first, or the file system refused
        if fs.exists(manifest):
            return False
        raise
    out.write(bytearray(f"{attempt}\n".encode()))
    out.close()
    return True


def answer_once(requests: DataFrame, answer: Callable[[str], str], path: str) -> DataFrame:
    """`requests` (`key`, `prompt`) with `result`: only keys that the store lacks are inferred, and what was inferred is
    appended. A request whose inference failed has no result, is not stored, and is tried again next time."""
    spark = requests.sparkSession
    missing = summary_misses(requests.select("key", "prompt"), stored_results(spark, path))
    batch = batch_name(missing)
    if not batch.startswith("0-"):
        answered = infer(missing, answer, ["key"]).where("error is null").select("key", "result")
        append_results(answered, path, batch)
    return requests.join(stored_results(spark, path), "key", "left")
