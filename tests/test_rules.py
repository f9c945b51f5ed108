"""Sequential rules against plain loops on random input, ties and exact limits included."""

import random

import pytest
from pyspark.sql import functions as F

from lecturelab.operators import asr, boards, intervals, retrieval, segmentation
from lecturelab.params import AsrParams, SegmentParams


def test_rejection_reasons(spark):
    word = "да " * 8
    rows = [("speech", .85, -.2), ("speech", .9, -1.3), ("speech", .1, -1.3), ("speech", .1, -2.0), (word, .1, -.3), ("  ", .1, -.1),
            ("speech", None, -1.3), ("speech", .9, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, no_speech_prob double, avg_logprob double")
    got = [r.reason for r in asr.with_reason(df).orderBy("i").collect()]
    assert got == [None, "silence", None, "low_confidence", "repetition", "empty", None, None]


@pytest.mark.parametrize("seed", range(3))
def test_regroup_equals_a_loop(spark, seed):
    rng, p = random.Random(seed), AsrParams()
    rows, want = [], {}
    for lec in ("x", "y"):
        t, group, first, prev_end, closed = 0.0, None, 0.0, None, False
        for seq in range(0, 240, 2):  # gaps in seq: rejected segments
            t = round(t + rng.choice([0.0, 0.3, 1.1, 1.2, 1.5]), 1)
            end = round(t + rng.choice([1.0, 4.0, 11.0, 20.0]), 1)
            text = rng.choice(["and so", "done.", "really?", "no end"])
            if group is None or t - prev_end >= 1.2 or end - first >= 45 or (closed and end - first >= 12):
                group, first = seq, t
            want[(lec, seq)] = group
            rows.append((lec, seq, t, end, text))
            prev_end, closed, t = end, text[-1] in ".?", end
    df = spark.createDataFrame(rows, "lecture_id string, seq int, start_s double, end_s double, text string")
    for size in (7, 65_536):
        got = {(r.lecture_id, r.seq): r.grp for r in asr.regroup(df, p, size).collect()}
        assert got == want


def test_chunks_equal_a_loop(spark):
    rng = random.Random(4)
    cases = [[rng.choice([0, 3, 20, 50, 230]) for _ in range(rng.randint(1, 30))] for _ in range(40)]

    def loop(words, target=220, overlap=40):
        out, lo = [], 0
        for at in range(len(words)):
            if sum(words[lo:at + 1]) >= target:
                out.append((lo, at))
                k, total = at + 1, 0
                while k > lo and total < overlap:
                    k -= 1
                    total += words[k]
                lo = k
        return out + ([(lo, len(words) - 1)] if lo < len(words) else [])

    df = spark.createDataFrame([(i, w) for i, w in enumerate(cases)], "i int, w array<int>")
    got = df.select("i", retrieval.chunk_windows(F.col("w"), 220, 40).alias("c")).collect()
    for r in got:
        assert [(c.lo, c.hi) for c in r.c] == loop(cases[r.i])


def test_depth_equals_a_loop(spark):
    rng = random.Random(5)
    c = [rng.choice([0.0, 0.1, 0.25, 0.5]) for _ in range(80)]
    raw = []
    for i in range(len(c)):
        j = i
        while j > 0 and c[j - 1] >= c[j]:
            j -= 1
        k = i
        while k < len(c) - 1 and c[k + 1] >= c[k]:
            k += 1
        raw.append(round(c[j] - c[i] + c[k] - c[i], 9))
    want = [(x - min(raw)) / (max(raw) - min(raw)) for x in raw]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(c)], "lecture_id string, i int, cohesion double")
    for size in (4, 1000):
        got = [r.depth for r in segmentation.cohesion_depth(df, size).orderBy("i").collect()]
        assert got == pytest.approx(want, abs=1e-8)


def boundaries_by_loop(scores, times, first, last, p):
    chosen = []
    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        if scores[i] >= p.min_score and all(abs(times[i] - times[c]) >= p.min_seconds for c in chosen):
            chosen.append(i)
    out, at = set(), first
    for i in sorted(chosen) + [None]:
        stop = last if i is None else times[i]
        while stop - at > p.max_seconds:
            free = [j for j in range(len(scores)) if at + p.min_seconds <= times[j] <= at + p.max_seconds]
            if not free:
                break
            best = max(free, key=lambda j: (scores[j], -j))
            out.add(best)
            at = times[best]
        if i is not None:
            out.add(i)
            at = stop
    return out


@pytest.mark.parametrize("kind", ["random", "rising", "quiet", "ties"])
def test_boundaries_equal_a_loop(spark, kind):
    rng, p, n = random.Random(6), SegmentParams(), 400
    ends = [20.0 * (i + 1) + (5.0 if i % 3 else 0.0) for i in range(n)]
    score = {
        "random": lambda i: round(rng.random(), 3), "rising": lambda i: round(0.3 + i / 1000, 4),  # one chain through all hours
        "quiet": lambda i: round(rng.random() * 0.2, 3), "ties": lambda i: rng.choice([0.1, 0.3, 0.6])}[kind]
    scores = [score(i) for i in range(n - 1)]
    u = spark.createDataFrame([("x", i, ends[i] - 15, ends[i]) for i in range(n)], "lecture_id string, uid int, start_s double, end_s double")
    s = spark.createDataFrame([("x", i, v) for i, v in enumerate(scores)], "lecture_id string, i int, score double")
    want = boundaries_by_loop(scores, ends[:-1], ends[0] - 15, ends[-1], p)
    got = segmentation.select_boundaries(u, s, p, hour=700.0, halo=200.0)
    assert {r.i for r in got.collect()} == want
    segs = segmentation.build_segments(u, got, s).orderBy("sid").collect()
    assert [x for r in segs for x in r.utterance_ids] == list(range(n))  # segments partition the utterances


def test_matching_equals_a_loop(spark):
    rng = random.Random(7)
    truth = sorted({float(rng.randint(0, 300)) for _ in range(60)})
    pred = sorted({float(rng.randint(0, 300)) for _ in range(50)})
    used = set()
    for t in truth:
        for i, p in enumerate(pred):
            if i not in used and abs(p - t) <= 3:
                used.add(i)
                break
    make = lambda v: spark.createDataFrame([("x", t) for t in v], "lecture_id string, t double")
    got = intervals.match_marks(make(truth), make(pred), 3.0).first()
    assert (got.hits, got.n_true, got.n_pred) == (len(used), len(truth), len(pred))


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(8)
    us = [(i, s, s + rng.choice([0.0, 5.0, 40.0, 500.0])) for i, s in enumerate(rng.uniform(0, 900) for _ in range(80))]
    sp = [(i, s, s + rng.choice([10.0, 130.0])) for i, s in enumerate(rng.uniform(0, 900) for _ in range(40))]
    want = {(u, p) for u, a, b in us for p, c, d in sp if b > a and max(0.0, min(b, d) - max(a, c)) / (b - a) >= 0.5}
    udf = spark.createDataFrame([("x", *r) for r in us], "lecture_id string, uid int, start_s double, end_s double")
    sdf = spark.createDataFrame([("x", *r) for r in sp], "lecture_id string, sid int, span_start double, span_end double")
    got = [(r.uid, r.sid) for r in intervals.utterances_in(udf, sdf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_board_cuts_equal_a_loop(spark):
    rng = random.Random(9)
    d = [(i, rng.choice([0.0, 0.0, 0.0, 0.07]), rng.choice([0.0, 0.0, 0.02])) for i in range(1, 120)]
    edges = [0] + [i for i, a, r in d if r > 0.01 or a > 0.06] + [120]
    want = []
    for lo, hi in zip(edges, edges[1:]):
        if want and hi - lo < 3:
            want[-1] = (want[-1][0], hi)
        else:
            want.append((lo, hi))
    df = spark.createDataFrame([("x", *r) for r in d], "lecture_id string, frame_idx int, added double, removed double")
    for block in (5, 10_000):
        got = boards.board_cuts(df, 3, 0.01, 0.06, block=block).orderBy("state").collect()
        assert [(r.lo, r.hi) for r in got] == want


def test_search_falls_back_to_the_first_passage(spark):
    rows = spark.createDataFrame([("x", 0, "red apple"), ("x", 1, "green pear"), ("x", 2, "green apple tree")], "lecture_id string, row_id int, text string")
    asked = spark.createDataFrame([("x", 1, "apple tree"), ("x", 2, "unknown words")], "lecture_id string, query_id int, question string")
    hits = retrieval.search_topk(retrieval.sparse_scores(rows, asked), asked, rows, 2)
    got = {(r.query_id, r["rank"]): (r.cid, r.score) for r in hits.collect()}
    assert got[(1, 1)][0] == 2 and got[(1, 2)][0] == 0 and got[(2, 1)] == (0, 0.0) and len(got) == 3


def test_cohesion_drops_where_the_words_change(spark):
    text = ["red green blue"] * 6 + ["one two three"] * 6
    u = spark.createDataFrame([("x", i, t) for i, t in enumerate(text)], "lecture_id string, uid int, text string")
    c = segmentation.cohesion(u, segmentation.utterance_vectors(u), 3)
    depth = {r.i: r.depth for r in segmentation.cohesion_depth(c).collect()}
    assert max(depth, key=depth.get) == 5
    flat = spark.createDataFrame([("x", i, "same words") for i in range(10)], "lecture_id string, uid int, text string")
    assert {r.depth for r in segmentation.cohesion_depth(segmentation.cohesion(flat, segmentation.utterance_vectors(flat))).collect()} == {0.0}
