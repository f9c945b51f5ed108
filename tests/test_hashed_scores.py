"""Scores from hashed counts against plain loops; the postings are shuffled once."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lecturelab.operators import retrieval, termvectors


def grams(text):
    t = (text or "").lower().split()
    return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)])


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_counts_in_parts(spark, at_once):
    rng = random.Random(at_once)
    rows = [("a", k, " ".join(f"w{rng.randrange(5)}" for _ in range(rng.randrange(30))) if k % 7 else None) for k in range(60)]
    r = spark.createDataFrame(rows, "lecture_id string, row_id int, text string").coalesce(1)
    names = {h.h: h.t for h in spark.createDataFrame([(t,) for t in {t for _, _, x in rows for t in grams(x)}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    got = {(c.row_id, names[c.h]): c.tf for c in termvectors.hashed_counts(r, at_once).collect()}
    assert got == {(k, t): n for _, k, x in rows for t, n in grams(x).items()}


def test_scores_match_plain_loops(spark):
    rng = random.Random(5)
    said = lambda n: " ".join(f"w{rng.randrange(12)}" for _ in range(n))
    rows = [(lec, k, said(rng.randrange(25)) if k % 9 else None) for lec, n in (("a", 60), ("b", 1), ("c", 7)) for k in range(n)]
    questions = [("a", q, said(4)) for q in range(5)] + [("b", 9, "w1 w2"), ("c", 10, "unknown words"), ("none", 11, "w1")]
    r = spark.createDataFrame(rows, "lecture_id string, row_id int, text string").repartition(3)
    q = spark.createDataFrame(questions, "lecture_id string, query_id int, question string")
    want = {}
    for lec in "abc":
        own = {k: grams(t) for x, k, t in rows if x == lec}
        df = Counter(t for c in own.values() for t in c)
        idf = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, n in df.items()}
        vector = lambda c: {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        size = lambda v: math.sqrt(sum(x * x for x in v.values()))
        for x, query, text in questions:
            mine = vector(grams(text))
            for k, c in own.items() if x == lec else ():
                v = vector(c)
                if set(v) & set(mine):
                    want[lec, query, k] = sum(w * v.get(t, 0) for t, w in mine.items()) / size(v) / size(mine)
    found = retrieval.sparse_scores(r, q)
    got = {(s.lecture_id, s.query_id, s.cid): s.score for s in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want) and want
    # one window over the postings, no table of counts
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert not any("term-counts" in path for path in found.inputFiles())


def test_postings_packed_by_part(spark, monkeypatch):
    """A recording's terms dealt into many parts: lengths of passages are the same, and a part's postings are one row per task's batch."""
    rng = random.Random(8)
    rows = [("a", k, " ".join(f"w{rng.randrange(30)}" for _ in range(20))) for k in range(50)] + [("b", 0, None), ("b", 1, "w1 w2 w1")]
    r = spark.createDataFrame(rows, "lecture_id string, row_id int, text string").coalesce(1)
    words = termvectors.hashed_words(r)
    monkeypatch.setattr(termvectors, "WORDS_OF_PART", 100)
    sizes = termvectors.lecture_sizes(words)
    assert {s.lecture_id: (s.n, s.parts) for s in sizes.collect()} == {"a": (50, 10), "b": (2, 1)}
    assert termvectors._packed(words, sizes).count() <= 11
    got = {}
    for s in termvectors.squared_lengths(words, sizes).collect():
        got[s.lecture_id, s.row_id] = got.get((s.lecture_id, s.row_id), 0.0) + s.sq
    for lec in "ab":
        own = {k: grams(t) for x, k, t in rows if x == lec}
        df = Counter(t for c in own.values() for t in c)
        for k, c in own.items():
            want = sum(((1 + math.log(n)) * (math.log((1 + len(own)) / (1 + df[t])) + 1)) ** 2 for t, n in c.items())
            assert got.get((lec, k), 0.0) == pytest.approx(want)
