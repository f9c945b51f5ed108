import pytest
from pyspark.sql import functions as F

from lecturelab.functions import timecode as C
from lecturelab.functions.mathtext import extract_math
from lecturelab.functions.text import latex_escape, truncate_words
from lecturelab.operators import evaluation, prompts
from lecturelab.operators.answers import extract_json
from lecturelab.operators.latex import latex_quality, latex_repair, latex_sanitise


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v " + ("double" if isinstance(value, float) else "string")).select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("s,tc", [(0.0, "00:00"), (61.0, "01:01"), (754.2, "12:34"), (3600.0, "1:00:00"), (4210.0, "1:10:10")])
def test_timecodes(spark, s, tc):
    assert one(spark, C.to_timecode, s) == tc
    assert one(spark, C.from_timecode, tc) == pytest.approx(s, abs=0.5)


def test_bad_timecodes_are_null(spark):
    assert one(spark, C.from_timecode, "1:2:3:4") is None and one(spark, C.from_timecode, "soon") is None


def test_seconds_are_added_once(spark):
    body = "see \\ts{12:34} and \\ts{1:00:00}"
    full = one(spark, C.with_seconds, body)
    assert full == "see \\ts[754]{12:34} and \\ts[3600]{1:00:00}" and one(spark, C.with_seconds, full) == full


def test_small_texts(spark):
    assert one(spark, lambda v: truncate_words(v, 2), "a b  c") == "a b …"
    assert one(spark, latex_escape, "a_b\\{c}~%") == "a\\_b\\textbackslash{}\\{c\\}\\textasciitilde{}\\%"


@pytest.mark.parametrize("reply,json", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": 1} ok', '{"a": 1}'), ("x [1, 2] y", "[1, 2]"), ("none {x}", None)])
def test_json_replies(spark, reply, json):
    assert one(spark, extract_json, reply) == json


@pytest.mark.parametrize("body,errors", [
    ("\\begin{align} a &= b \\end{align}", []), ("cost 5 $ only", ["dollar-parity"]),
    ("\\begin{align} x", ["begin-without-end: align"]), ("100\\% \\{ sure \\}", []), ("\\usepackage{x}", ["preamble-command"]),
    ("\\begin{proof} x \\end{lemma}", ["end-without-begin: lemma"]), ("% {\nfine", [])])
def test_latex_checks(spark, body, errors):
    assert one(spark, lambda v: latex_quality(v)["errors"], body) == errors


def test_latex_cleaning(spark):
    fenced = "```latex\n\\documentclass{a}\\begin{document}$$x$$\n\n\n\ny\\end{document}\n```"
    assert one(spark, latex_sanitise, fenced) == "\\[x\\]\n\ny"
    assert one(spark, latex_sanitise, "\\note keep it short\n\nrest") == "\\begin{note}\nkeep it short\n\\end{note}\n\nrest"
    broken = one(spark, latex_repair, "a {")
    assert not broken.ok and broken.body.startswith("\\begin{quote}") and "a \\{" in broken.body


def test_formulas(spark):
    tex = "text $x+y$ and $$\\left( a \\right)$$ \\[ \\mathbb{R}^n \\] \\begin{align*}z=1\\end{align*} $q$"
    assert sorted(one(spark, extract_math, tex)) == sorted(["(a)", "\\mathbfR^n", "z=1", "x+y"])


def test_scores(spark):
    notes = spark.createDataFrame([(1, "$a+b$ gradient gradient descent descent")], "doc_id long, text string")
    other = spark.createDataFrame([(1, "$a+c$ gradient gradient matrix matrix")], "doc_id long, text string")
    assert evaluation.formula_prf(notes, notes).first().f1 == 1.0
    assert evaluation.formula_prf(notes, other).first().recall == 0.0
    assert evaluation.term_coverage(notes, other).first().coverage == 0.5
    assert [r.term for r in evaluation.missing_terms(notes, other).collect()] == ["matrix"]


def flags(spark, ref, hyp, n=40):
    return spark.createDataFrame([("x", i, int(i in ref), int(i in hyp)) for i in range(n)], "lecture_id string, pos int, ref int, hyp int")


def test_window_errors(spark):
    perfect = evaluation.window_errors(flags(spark, {10, 20, 30}, {10, 20, 30}), block_rows=7).first()
    near = evaluation.window_errors(flags(spark, {20}, {21})).first()
    missed = evaluation.window_errors(flags(spark, {20}, set())).first()
    assert (perfect.pk, perfect.window_diff) == (0.0, 0.0)
    assert 0 < near.pk < missed.pk <= 1 and evaluation.window_errors(flags(spark, {1}, {0}, 2)).first().pk == 0.0


def test_infer_raises_only_when_all_fail(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string")

    def fake(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt * 2

    got = {r.id: (r.result, r.error) for r in prompts.infer(rows, fake, ["id"]).collect()}
    assert got == {1: ("okok", None), 2: (None, "no")}
    with pytest.raises(RuntimeError):
        prompts.infer(rows.where("id = 2"), fake, ["id"])
