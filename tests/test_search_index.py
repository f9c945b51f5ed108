"""The stored index against full comparison: sparse, dense and hybrid, in batches."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lecturelab.operators import searchindex

WORDS = [f"wort{k}" for k in range(60)]


def corpus(rng):
    rows, vectors = [], []
    for lecture, n in (("a", 300), ("b", 40), ("c", 1), ("d", 70)):
        base = rng.choices(WORDS, k=20)
        centres = np.array([[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)])
        for k in range(n):
            words = rng.choices(base if k % 3 else WORDS, k=rng.randrange(0, 30))
            rows.append((lecture, k, " ".join(words)))
            if k % 11 != 3 and lecture != "d":
                v = centres[k % 8] + 0.2 * np.array([rng.gauss(0, 1) for _ in range(6)])
                vectors.append((lecture, k, [0.0] * 6 if k == 5 else [float(x) for x in v]))
    questions = [(lec, q, " ".join(rng.choices(WORDS, k=6)) if q else "unknown") for lec in "abcd" for q in range(6)] + [("none", 9, WORDS[0])]
    asked = [(lec, q, [rng.gauss(0, 1) for _ in range(6)]) for lec, q, _ in questions if q % 4]
    return rows, vectors, questions, asked


def terms(text):
    t = re.findall(r"\w{2,}", text.lower())
    return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])


def plain(rows, vectors, questions, asked, weight, k=6, dense=True):
    """Every question against every passage of its recording."""
    out = {}
    v, q = ({(a, b): np.array(x) for a, b, x in own} for own in (vectors, asked))
    unit = lambda x: x / max(np.linalg.norm(x), 1e-8)
    for lec, query, text in questions:
        own = [(r, terms(t)) for lec2, r, t in rows if lec2 == lec]
        df = Counter(t for _, c in own for t in c)
        idf = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, n in df.items()}
        weigh = lambda c: {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}  # noqa: B023, E731
        norm = lambda w: {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
        mine = norm(weigh(terms(text)))
        scored = []
        for r, c in own:
            w = norm(weigh(c))
            s = round(sum(x * w.get(t, 0) for t, x in mine.items()), 9)
            d = round(float(unit(q[lec, query]) @ unit(v[lec, r])), 9) if (lec, query) in q and (lec, r) in v else 0.0
            if dense or any(t in w for t in mine):
                scored.append((-round((1 - weight) * s + weight * d, 9), r))
        out[lec, query] = [(r, -s) for s, r in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize(("weight", "dense"), [(0.0, False), (0.5, True), (1.0, True)])
def test_index_gives_what_full_comparison_gives(spark, weight, dense):
    rows, vectors, questions, asked = corpus(random.Random(int(weight * 2) + 1))
    r = spark.createDataFrame(rows, "lecture_id string, row_id int, text string")
    v = spark.createDataFrame(vectors, "lecture_id string, row_id int, embedding array<float>") if dense else None
    index = searchindex.build_index(r, vectors=v, block_passages=16)
    again = searchindex.open_index(spark, index.path)
    vectors = [(a, b, np.float32(x).tolist()) for a, b, x in vectors]
    asked = [(a, b, np.float32(x).tolist()) for a, b, x in asked]
    want = plain(rows, vectors, questions, asked, weight, dense=dense)
    for batch in (questions[::2], questions[1::2]):
        q = spark.createDataFrame(batch, "lecture_id string, query_id int, question string")
        qv = spark.createDataFrame(asked, "lecture_id string, query_id int, embedding array<float>") if dense else None
        hits = searchindex.best_passages(again, q, vectors=qv, weight=weight)
        assert all("term-counts" not in path for path in hits.inputFiles())  # no text, no counts of texts
        got = {}
        for h in sorted(hits.collect(), key=lambda h: h["rank"]):
            got.setdefault((h["lecture_id"], h["query_id"]), []).append((h["cid"], h["score"]))
        for lec, query, _ in batch:
            mine, full = got.get((lec, query), []), want[lec, query]
            assert [s for _, s in mine] == pytest.approx([s for _, s in full], abs=2e-8), (lec, query)
            assert len({c for c, _ in mine} ^ {c for c, _ in full}) <= 2 * sum(abs(s - full[-1][1]) < 2e-8 for _, s in full) - 2 or mine == full or [c for c, _ in mine] == [c for c, _ in full]


def test_blocks_out_of_reach_are_not_scored(spark):
    """One passage has the question's word, the other blocks cannot reach its score."""
    rows = [("a", k, f"only{k} filler{k % 3}") for k in range(400)]
    index = searchindex.build_index(spark.createDataFrame(rows, "lecture_id string, row_id int, text string"), block_passages=10)
    q = spark.createDataFrame([("a", 1, "only7 filler0")], "lecture_id string, query_id int, question string")
    asked = searchindex.asked_terms(index, q)
    bounds = searchindex._bounds(index, asked, None, 0.0).collect()
    assert len(bounds) == 40 and sum(b["bound"] > 0.6 for b in bounds) == 1
    best = searchindex.best_passages(index, q, k=1).collect()
    assert best[0]["cid"] == 7


def test_no_question_and_no_passage(spark):
    rows = spark.createDataFrame([("a", 0, "one two")], "lecture_id string, row_id int, text string")
    q = spark.createDataFrame([("a", 1, ""), ("b", 2, "one")], "lecture_id string, query_id int, question string")
    index = searchindex.build_index(rows)
    assert [tuple(r) for r in searchindex.search_index(index, q).collect()] == [("a", 1, 1, 0, 0.0)]
    assert searchindex.search_index(index, q.limit(0)).count() == 0
    assert searchindex.search_index(searchindex.build_index(rows.limit(0)), q).count() == 0


def test_index_moves_postings_once(spark):
    """No table of terms and no table of block weights: what is stored is little more than the postings; a cap is still a cap."""
    rows = [("a", k, f"only{k} filler{k % 3} filler{k % 3} rare") for k in range(40)]
    r = spark.createDataFrame(rows, "lecture_id string, row_id int, text string")
    q = spark.createDataFrame([("a", 1, "only7 filler0")], "lecture_id string, query_id int, question string")
    index = searchindex.build_index(r)
    stored = {p.name for p in Path(index.path).iterdir()}
    assert stored == {"postings", "rows", "blocks"} and "term" not in index.table("postings").columns
    assert index.table("postings").count() == sum(len(terms(t)) for _, _, t in rows)
    capped = searchindex.build_index(r, max_features=2)
    # "rare" and "filler0" are the most frequent terms
    assert capped.table("postings").count() == 40 + sum(k % 3 == 0 for k in range(40))
    assert {h["cid"] for h in searchindex.best_passages(capped, q).collect()} == {0, 3, 6, 9, 12, 15}
