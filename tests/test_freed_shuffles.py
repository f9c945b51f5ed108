"""What a chain of stored tables leaves on disk."""

import os

import __spark_entry__ as entry
import pytest
from conftest import SF
from lecturelab.plans import segmentation
from lecturelab.session import dropping_steps, freeing_shuffles, materialise
from lecturelab.sources import tables as T
from pyspark.sql import functions as F


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}


def test_shuffle_files_go_with_their_query(spark):
    key, rows = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before, kept = spark.conf.get(key), shuffle_files(spark)
    with freeing_shuffles(spark):
        assert materialise(rows, "freed").count() == 10
    assert shuffle_files(spark) <= kept and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), freeing_shuffles(spark):
        1 / 0
    assert spark.conf.get(key) == before


def test_steps_go_and_their_result_stays(spark):
    outer = materialise(spark.range(3), "outer")
    with dropping_steps(spark):
        step = materialise(spark.range(7), "step")
        with dropping_steps(spark):
            inner = materialise(materialise(step, "inner-step"), "inner")
        result = materialise(inner.where("id > 2"), "result")
    assert result.count() == 4 and outer.count() == 3
    assert [os.path.exists(f.inputFiles()[0].removeprefix("file://")) for f in (step, inner, result, outer)] == [False, False, True, True]


def test_a_chain_of_questions_leaves_only_its_last_shuffles(spark):
    kept = shuffle_files(spark)
    answers = entry.queries()["ask_recordings"](spark, SF)
    assert len(shuffle_files(spark) - kept) == 0
    assert answers.count() > 100


def test_lengths_of_recordings_are_those_of_their_times(spark, monkeypatch):
    """Boards and durations from stored times are those from the texts; only cohesion and the speech itself read the texts."""
    times = segmentation._times(spark, SF)
    monkeypatch.setattr(segmentation, "_scores", lambda *a: spark.createDataFrame([], "lecture_id string, i int, score double"))
    sized, boards = segmentation.sizes_and_boards(spark, SF, times)
    parts = segmentation.segments_of(spark, SF, times, sized, boards)
    want = T.boards(spark, SF).select(*boards.columns)
    assert want.exceptAll(boards).count() == 0 and boards.exceptAll(want).count() == 0
    short = T.lectures(spark, SF).join(T.speech(spark, SF).groupBy("lecture_id").count().where("count < 4"), "lecture_id")
    want = {r["lecture_id"]: max(r["duration"], 1.0) for r in short.collect()}
    got = {r["lecture_id"]: r["end_s"] for r in parts.collect() if r["lecture_id"] in want}
    assert got == want and want
