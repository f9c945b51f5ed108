"""Regrouping of a stream whose rows come in any order inside the lateness, over many triggers."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from lecturelab.operators import asr
from lecturelab.params import AsrParams
from lecturelab.session import scratch_path
from lecturelab.streaming import live

BASE = dt.datetime(2024, 1, 1)


def test_any_order_inside_the_lateness(spark):
    rng, t, rows = random.Random(5), 0.0, []
    for seq in range(600):
        t = round(t + rng.choice([0.0, 0.3, 1.3]), 1)
        end = round(t + rng.choice([1.0, 4.0, 11.0]), 1)
        rows.append(("x", seq, t, end, rng.choice(["done.", "and so"]), BASE + dt.timedelta(seconds=t)))
        t = end
    schema = "lecture_id string, seq int, start_s double, end_s double, text string, ts timestamp"
    come = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 100))
    path = scratch_path(spark, "feed")
    for part in (come[:200], come[200:400], come[400:], [("end", 0, 9e5, 9e5, "x", BASE + dt.timedelta(days=30))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    progress = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.run_available(live.stream_regroup(stream, AsrParams(), "10 minutes"), "groups", progress=progress).where("lecture_id = 'x'")
    df = spark.createDataFrame([r[:5] for r in rows], "lecture_id string, seq int, start_s double, end_s double, text string")
    want = asr.regroup(df).groupBy("grp").agg(F.min("start_s").alias("s"), F.max("end_s").alias("e"), F.count("*").alias("n"))
    assert {tuple(r)[1:] for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert live.late_rows(progress) == 0


class Calls:
    """State and timers in plain memory; every call is counted."""

    def __init__(self):
        self.n, self.timers, self.values, self.value = 0, set(), {}, None

    def __getattr__(self, name):
        ways = {
            "getValueState": lambda *_: self, "getMapState": lambda *_: self, "registerTimer": self.timers.add,
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "clear": lambda: setattr(self, "value", None), "keys": lambda: list(self.values), "containsKey": self.values.__contains__,
            "getValue": self.values.__getitem__, "updateValue": self.values.__setitem__, "removeKey": self.values.pop}

        def call(*args):
            self.n += 1
            return ways[name](*args)
        return call


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_few_calls_of_the_state(spark):
    """Rows with a minute of their own, in two triggers: calls go with chunks; a chunk is folded as far as the watermark has come."""
    calls, p = Calls(), live.RegroupProcessor(AsrParams())
    p.init(calls)
    rows = pd.DataFrame({"seq": range(600), "start_s": [k * 60.0 for k in range(600)], "end_s": [k * 60.0 + 1 for k in range(600)], "closes": True})
    rows["ts"] = pd.to_datetime(rows["start_s"], unit="s").astype("datetime64[us]")
    for part in (rows[::2], rows[1::2]):
        list(p.handleInputRows(("x",), iter([part]), At(0)))
    found = []
    for until in (300 * 60_000, 10**12):
        for _ in [t for t in calls.timers if t <= until]:
            found += [x for x in p.handleExpiredTimer(("x",), At(until), None)]
    got = pd.concat(found)
    assert sorted(got["grp"]) == list(range(600)) and set(got["segments"]) == {1}
    assert calls.n < 60
