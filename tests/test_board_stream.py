"""Board cuts of a stream: many triggers, frames out of order, a bounded state."""

import random

from pyspark.sql import functions as F

from lecturelab.params import BoardParams
from lecturelab.session import scratch_path
from lecturelab.streaming import live

SCHEMA = "lecture_id string, frame_idx int, n_px int, words array<bigint>, ts double"


def written(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_frames_in_any_order_over_many_triggers(spark):
    rng = random.Random(2)
    mask, rows = 0, []
    for k in range(1000):
        mask = rng.getrandbits(64) if rng.random() < 0.1 else mask ^ (1 << rng.randrange(64) if rng.random() < 0.3 else 0)
        rows.append(("a", k, 64, [mask & 0xFFFFFFFF, mask >> 32], float(k)))
    p = BoardParams(tau_erase=0.05, tau_jump=0.05)
    bits = [r[3][0] | r[3][1] << 32 for r in rows]
    want = [k for k in range(1, 1000) if max((bits[k - 1] & ~bits[k]).bit_count(), (bits[k] & ~bits[k - 1]).bit_count()) / 64 > 0.05]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 15))
    batches = [shuffled[k:k + 100] for k in range(0, 1000, 100)]
    stream = written(spark, scratch_path(spark, "frames"), batches)
    progress = []
    got = live.run_available(live.stream_board_cuts(stream, p, "30 seconds", "5 seconds"), "cuts", progress=progress)
    assert sorted(r["frame_idx"] for r in got.collect()) == want and len(want) > 50
    assert live.late_rows(progress) == 0 and len(progress) >= 10
    assert live.state_rows(progress) < 600  # of 2 000 frames on both sides


def test_late_frames_are_counted(spark):
    at = lambda k: ("a", k, 64, [k, 0], float(k))
    batches = [[at(k) for k in range(50)], [at(k) for k in range(500, 550)], [at(k) for k in range(560, 570)], [at(60), at(61)]]
    progress = []
    stream = written(spark, scratch_path(spark, "late"), batches)
    out = live.run_available(live.stream_board_cuts(stream, BoardParams(tau_erase=0.0, tau_jump=0.0), "30 seconds", "5 seconds"), "late-cuts", progress=progress)
    assert out.where(F.col("frame_idx").between(60, 61)).count() == 0
    assert live.late_rows(progress) == 4  # two frames on each side of the join
