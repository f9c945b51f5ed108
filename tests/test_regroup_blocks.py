"""Regrouping of one long session over many blocks against a loop from its start."""

import random

import pytest
from pyspark.sql import functions as F

from lecturelab.operators import asr
from lecturelab.params import AsrParams


def loop(rows, p):
    group, first, prev_end, closed, out = None, 0.0, None, False, {}
    for seq, start, end, text in rows:
        if group is None or start - prev_end >= p.group_pause or end - first >= p.group_max_seconds or (closed and end - first >= p.group_min_seconds):
            group, first = seq, start
        out[seq] = group
        prev_end, closed = end, text.endswith(".")
    return out


def talk(rng, n, sentences, gaps, lengths):
    t, rows = 0.0, []
    for seq in range(n):
        t = round(t + rng.choice(gaps), 2)
        end = round(t + rng.choice(lengths), 2)
        rows.append((seq, t, end, "done." if rng.random() < sentences else "and so"))
        t = end
    return rows


CASES = {
    "no pause, no sentence": (0.0, [0.0], [0.5, 2.0]), "every row ends a sentence": (1.0, [0.0], [0.5]),
    "short rows": (0.2, [0.0, 0.1], [0.0, 0.05]), "ends out of order": (0.3, [0.0, -3.0, 0.4], [0.5, 6.0, 30.0]),
    "a group over many blocks": (0.0, [0.0], [0.01]), "pauses": (0.2, [0.0, 0.3, 1.2, 4.0], [0.5, 3.0])}


@pytest.mark.parametrize("case", CASES)
def test_blocks_give_what_one_pass_gives(spark, case):
    rng, p = random.Random(case), AsrParams()
    rows = talk(rng, 3_000, *CASES[case])
    df = spark.createDataFrame([("x", *r) for r in rows], "lecture_id string, seq int, start_s double, end_s double, text string")
    want = loop(rows, p)
    for size in (7, 500):
        assert {r.seq: r.grp for r in asr.regroup(df, p, size).select("seq", "grp").collect()} == want


def test_a_long_session_without_a_pause(spark):
    n, size = 200_000, 8_192
    df = spark.range(n, numPartitions=8).select(
        F.lit("x").alias("lecture_id"), F.col("id").cast("int").alias("seq"), (F.col("id") * 0.5).alias("start_s"), (F.col("id") * 0.5 + 0.5).alias("end_s"),
        F.when(F.xxhash64("id") % 7 == 0, "done.").otherwise("and so").alias("text"))
    out = asr.regroup(df, AsrParams(), size)
    opened = [r.seq for r in out.where("grp = seq").select("seq").orderBy("seq").collect()]
    texts = [r.text for r in df.select("text", "seq").orderBy("seq").collect()]
    want = loop([(i, i * 0.5, i * 0.5 + 0.5, t) for i, t in enumerate(texts)], AsrParams())
    assert opened == sorted(set(want.values())) and out.count() == n
