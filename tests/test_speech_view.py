import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from lecturelab.functions.mathtext import REWRITES, normalise_math
from lecturelab.operators import evaluation as E
from lecturelab.sources import tables as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_formulas_of_both_sides_come_from_one_reading(spark):
    plan = _plan(entry.queries()["formula_prf"](spark, SF))
    assert plan.count("documents.parquet") == 1 and plan.count("Exchange ") == 1


def test_sides_in_a_row_score_as_sides_apart(spark):
    rows = [(1, "$a+b$ and $$c_{1}$$", r"\[a + b\]"), (1, None, "$c_1 d$"), (2, "none", "$xyz$"), (3, "$uvw$ $uvw$", None)]
    both = spark.createDataFrame(rows, "doc_id long, generated string, reference string")
    apart = E.formula_prf(*[both.select("doc_id", F.col(c).alias("text")) for c in ("generated", "reference")])
    assert sorted(E.formula_prf_by_row(both).collect()) == sorted(apart.collect())


def test_rewrites_are_those_of_the_whole_list(spark):
    texts = [f"{a}{{x}} y {b}" for a, _ in REWRITES for b in ("", r"\mathbb Q", r"\text{a b}", "\\le\\!ft")] + ["\tplain {x}\n", r"\\mathbb{t}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def every(f):
        for old, new in REWRITES:
            f = F.replace(f, F.lit(old), F.lit(new))
        return F.regexp_replace(F.regexp_replace(f, r"\\(?:label|tag|text|mathrm)\{([^}]*)\}", "$1"), r"[{}\s]+", "")

    assert df.where(~normalise_math(F.col("t")).eqNullSafe(every(F.col("t")))).collect() == []


def test_segments_are_runs_of_the_speech(spark, tmp_path):
    texts = [(1, "One two. Three! " * 20), (2, ""), (3, None), (4, "a b.\n\n c? d"), (4, "again e f. g")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = T.segments(spark, str(tmp_path)).select("lecture_id", "sid", "start_s", "end_s", "utterance_ids")
    rows = T.speech(spark, str(tmp_path)).withColumn("sid", F.floor(F.col("uid") / T.SEGMENT_UTTERANCES).cast("int"))
    want = rows.groupBy("lecture_id", "sid").agg(F.min("start_s"), F.max("end_s"), F.sort_array(F.collect_list("uid")))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
    assert "uid" not in _plan(got.select("lecture_id", "sid"))  # not folded from utterances


def test_speech_around_boards_leaves_other_texts_whole(spark):
    boards = T.boards(spark, SF).select("lecture_id").distinct()
    want = T.speech(spark, SF).join(boards, "lecture_id", "left_semi")
    got = T.speech(spark, SF, with_boards=True).join(boards, "lecture_id", "left_semi")
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    assert T.speech(spark, SF, with_boards=True).count() < T.speech(spark, SF).count()


@pytest.mark.parametrize("name", ["match_marks", "lecture_header"])
def test_texts_are_not_read_again_for_each_use(spark, name):
    assert _plan(entry.queries()[name](spark, SF)).count("documents.parquet") == 0


def test_sections_take_texts_apart_once_for_segments(spark):
    plan = _plan(entry.queries()["section_prompts"](spark, SF))
    assert plan.count("documents.parquet") == 2  # speech and boards
