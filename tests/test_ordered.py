import random

import pandas as pd
from pyspark.sql import functions as F

from lecturelab.operators.ordered import block_of, dense_index, running, shifted, top_n


def frame(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(k, i, rng.choice([None, 1.0, 2.0, 5.0])) for k in "ab" for i in range(n)]
    return spark.createDataFrame(rows, "k string, i int, v double"), pd.DataFrame(rows, columns=["k", "i", "v"])


def test_running_kinds_do_not_depend_on_the_block_size(spark):
    df, pdf = frame(spark)
    g = pdf.groupby("k")["v"]
    want = pd.DataFrame({
        "k": pdf.k, "i": pdf.i, "s": pdf.v.fillna(0).groupby(pdf.k).cumsum(), "l": g.ffill(), "n": g.bfill(),
        "p": pdf.groupby("k")["i"].shift(1)})
    for size in (1, 7, 1000):
        got = running(df, ["k"], ["i"], block_of(F.col("i"), size), {
            "s": ("sum", F.coalesce("v", F.lit(0.0))), "l": ("last", F.col("v")), "n": ("next", F.col("v")), "p": ("prev", F.col("i"))})
        got = got.select("k", "i", "s", "l", "n", F.col("p").cast("double").alias("p")).toPandas().sort_values(["k", "i"])
        pd.testing.assert_frame_equal(got.reset_index(drop=True), want, check_dtype=False)


def test_shifted_crosses_block_edges(spark):
    df, pdf = frame(spark)
    for size in (2, 5, 1000):
        got = shifted(df, ["k"], "i", {"b": ("i", -1), "a": ("i", 2)}, size).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
        assert len(got) == len(pdf)
        assert got.b.equals(pdf.groupby("k")["i"].shift(1)) and got.a.equals(pdf.groupby("k")["i"].shift(-2))


def test_dense_index_and_top_n(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 90, 17, 3000, 2)] + [("b", 1)], "k string, x long")
    got = {(r.k, r.x): r.pos for r in dense_index(df, ["k"], ["x"], block_of(F.col("x"), 10), "pos").collect()}
    assert got == {("a", 2): 0, ("a", 5): 1, ("a", 17): 2, ("a", 90): 3, ("a", 3000): 4, ("b", 1): 0}
    best = top_n(df, ["k"], [F.desc("x")], 2, spread=["x"], salts=3)
    assert {(r.k, r.x, r["rank"]) for r in best.collect()} == {("a", 3000, 1), ("a", 90, 2), ("b", 1, 1)}
