"""White space by table: every character against the rule that the SQL uses."""

import re

from pyspark.sql import functions as F

from lecturelab.functions import text
from lecturelab.functions.text import SPACE, squeeze, strip, word_count

PYTHON_SPACE = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), SPACE.replace(r"\s", r" \t\n\f\r"))


def test_every_character(spark):
    rows = [f"{c}a{c}{c}b {c}" for c in map(chr, range(1, 0x10000)) if not 0xD800 <= ord(c) < 0xE000] + ["", " ", "\U0001F600 x"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", strip(F.col("t")).alias("s"), word_count(F.col("t")).alias("n"), squeeze(F.col("t")).alias("q"))
    for r in df.collect():
        words = [w for w in re.split(f"{PYTHON_SPACE}+", r.t) if w]
        assert (r.n, r.s, r.q) == (len(words), re.sub(rf"\A{PYTHON_SPACE}+|{PYTHON_SPACE}+\Z", "", r.t), " ".join(words)), repr(r.t)
    assert spark.sql("select cast(null as string) as t").select(strip(F.col("t")).isNull(), word_count(F.col("t")) == 0).first()[:] == (True, True)


def test_a_word_is_not_looked_at_through_a_chain_of_classes(spark):
    """The plan of the speech view strips without a pattern."""
    from lecturelab.sources import tables

    plan = tables.speech(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_words_at_the_edges_of_the_quick_split(spark):
    """Texts of plain characters are split by the space alone; a character next to those that are plain is still looked at."""
    known = {"\x1f": True, " ": True, "~": False, "\x7f": False, "\x85": True, "\xa0": True, "\xa1": False, "ᙿ": False, " ": True, "　": True}
    rows = [(c, f" é{c}b  {c}") for c in known]
    got = {r["c"]: r["w"] for r in spark.createDataFrame(rows, "c string, t string").select("c", text.words_of(F.col("t")).alias("w")).collect()}
    assert got == {c: (["é", "b"] if gap else [f"é{c}b", c]) for c, gap in known.items()}
