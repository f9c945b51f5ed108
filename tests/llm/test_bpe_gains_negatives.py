"""Byte-level BPE against its public library, importance resampling and hard negatives against plain loops."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lecturelab.llm import bpe, importance, negatives, queries

SF = "/root/testdata/sf0.001"
RAW = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
TEXTS = st.lists(st.sampled_from(["a", "  ", " ", "'s", "'", "'ll", "l", "\n", "\t", "é", "Straße", " 12", "!!", "中文", "🙂", "the ", "aaaa", "=", "\x00", "\xa0", "<|endoftext|>"]), max_size=30).map("".join)


@given(TEXTS, st.sampled_from([1, 2, 3, 7]), st.sampled_from([1, 3, 24]), st.sampled_from([0, 1, 8]))
@settings(max_examples=400, deadline=None)
def test_any_tree_gives_the_library_s_ids(text, leaf, data_leaf, head):
    was = bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.HEAD
    try:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.HEAD = leaf, data_leaf, head
        OWN.words.clear()
        got = OWN.encode(text).tolist()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.HEAD = was
    assert got == LIBRARY.encode_ordinary(text) and OWN.decode(got) == text.encode()


@given(st.binary(max_size=400))
@settings(max_examples=200, deadline=None)
def test_wide_and_narrow_merges_agree(data):
    assert OWN._merged_long(data) == (OWN.merged_tree(data) if data else [])


def test_tokens_that_no_merge_leads_to():
    ranks = {bytes([k]): k for k in range(256)} | {b"abc": 256, b"de": 257, b"cd": 258}
    own = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("toy", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    was = bpe.LEAF_CHARS
    try:
        for bpe.LEAF_CHARS in (1, 3, 50):
            for text in ("abc", "abcde", "xabc", "abc abcabc", "abcd", "dede"):
                assert own.encode(text).tolist() == library.encode_ordinary(text)
    finally:
        bpe.LEAF_CHARS = was
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Vocabulary({b"a": 0}, public_tokenizers.PATTERN)


def test_long_matches():
    for text in ("a" * 30_001, " " * 9_999 + "x", "é" * 5_000, "\n " * 5_000):
        ids = OWN.encode(text).tolist()
        assert ids == LIBRARY.encode_ordinary(text) and OWN.decode(ids) == text.encode()


def test_encode_query_and_edges(spark):
    def want(text):
        ids = LIBRARY.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert {tuple(r) for r in got} == {(r["doc_id"], *want(r["text"])) for r in docs}
    own = bpe.tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = [(1, None, 7), (2, "", 7), (None, "x y", 7), (3, "long " * 60_000, 7), (3, "long " * 60_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    assert [tuple(r) for r in bpe.digests(df, own).collect()] == [(k, *want(t)) for k, t, _ in rows]
    back = bpe.decode(bpe.encode(df, own), own).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == 7 for r in back)
    assert bpe.digests(df.limit(0), own).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([None, 64],)], "tokens array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(odd, own).collect()] == [b"", b"", OWN.names[64]]


def plain_resample(rows, target, params):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % params.buckets for n in range(1, params.n + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(b for _, text in rows for b in grams(text)[1]), Counter(b for text in target for b in grams(text)[1])
    s_all, t_all = s.total(), t.total()
    out = []
    for key, text in rows:
        words, own = grams(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + params.buckets) / ((s[b] + 1) * (t_all + params.buckets)))) for b in own]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"{params.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long_enough = sorted((r for r in out if r[2] >= params.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(long_enough[: params.percent * len(long_enough) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_matches_plain_loops(spark, n, monkeypatch):
    rng = random.Random(n)
    words = ["The", "of", "É", "ok", "x1", "日本", "Z", "-", "end"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(500, None), (501, ""), (502, " ."), (None, "the end " * 30), (503, "hot row " * 20_000)] + [(7, rows[7][1] + " and more of it" * 10)] * 40
    target = ["The end of x1", None, "ok ok"]
    params = importance.ResampleParams(n=n, buckets=97, percent=35)
    df = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, score double")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(importance, "SLICE", 1000)
    got = [list(r) for r in importance.resample(df, aims, params).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[5] is None, r[5] or 0)
    assert sorted(got, key=order) == sorted(plain_resample(rows, target, params), key=order)
    assert importance.resample(df.limit(0), aims, params).count() == 0
    assert importance.resample(df, aims.limit(0), params).count() == len(rows)


def plain_negatives(rows, anchors=100, positives=5, count=5):
    own = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * float(x)) for x in vector]))
    out = []
    for k, (a, la, va) in enumerate(own):
        if a is None or a % anchors:
            continue
        scored = sorted(((sum(x * y for x, y in zip(va, v, strict=False)), b, lb) for j, (b, lb, v) in enumerate(own) if j != k), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for ps, p, _ in [r for r in scored if r[2] == la][:positives]:
            hard = [(b, s) for s, b, lb in scored if lb != la and 80 * ps <= 100 * s <= 100 * ps][:count]
            out += [(a, p, rank, b, ps, s) for rank, (b, s) in enumerate(hard, 1)]
    return out


def vectors(rng, n, dims=8, groups=12):
    centres = rng.normal(size=(groups, dims))
    own = centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dims))
    return (own / np.linalg.norm(own, axis=1, keepdims=True)).astype(np.float32)


SMALL = negatives.TreeParams(ways=4, depth=4, sample=120, leaf=12, block=20, chunk=7)


def mined(spark, rows, params=SMALL):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return [tuple(r) for r in negatives.mine(df.withColumn("rank", F.lit("x")), F.col("id") % 100 == 0, label=negatives.relabelled(), params=params).collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_negatives_match_plain_loops(spark):
    rng = np.random.default_rng(5)
    data = vectors(rng, 700)
    rows = [(int(k * 5), data[k].tolist(), int(rng.integers(0, 10))) for k in range(700)]
    hot = data[3].tolist()
    rows += [(10_000 + k, hot, 3) for k in range(200)] + [(10_000, hot, 3)]  # a hot vector, and an anchor given twice
    rows += [(20_000, None, 1), (20_100, hot, None), (20_200, [float("nan")] * 8, 1), (20_300, [None] + hot[1:], 1), (20_400, [float("inf")] * 8, 1)]
    rows += [(None, hot, 3), (None, hot, 4), (20_500, [], 2), (20_600, hot[:3], 2), (20_700, [0.0] * 8, 5), (-100, [-x for x in hot], 9)]
    got, want = mined(spark, rows), plain_negatives(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 200
    assert mined(spark, rows[:0]) == [] and mined(spark, [(1, hot, 1), (2, hot, 1)]) == [] and mined(spark, [(100, hot, 1)]) == []
    with pytest.raises(ValueError, match="exact below"):
        mined(spark, [(100, [1e30] * 8, 1)])


def test_search_passes_over_subtrees_and_loses_nothing():
    rng = np.random.default_rng(9)
    data = np.floor(256 * vectors(rng, 4000, 6, 40).astype(float))
    data[::9] *= 3  # norms differ
    reach = float((data * data).sum(axis=1).max())
    sample = rng.choice(4000, 600, replace=False)
    tree = negatives.fit(pd.DataFrame({"no": sample, "label": 0}), data[sample], reach, negatives.TreeParams(ways=6, depth=4, leaf=20))
    for node in tree.nodes:
        node.low, node.high = np.full((len(node.to),) * 2, np.inf), np.full((len(node.to),) * 2, -np.inf)
    for r in negatives.ranges_of(tree, data).itertuples():
        tree.nodes[r.node].low[r.i, r.j], tree.nodes[r.node].high[r.i, r.j] = r.low, r.high
    leaf = negatives.leaf_of(tree, data)
    asked = data[:200]
    scores = asked @ data.T
    top = np.sort(scores, axis=1)[:, -10]
    for least, most in ((top, np.full(200, reach)), (np.ceil(0.8 * top), top)):
        looked = np.zeros((200, tree.leaves), bool)
        for k, own in negatives.viable(tree, asked, least, most):
            looked[own, k] = True
        inside = (scores >= least[:, None]) & (scores <= most[:, None])
        a, b = np.nonzero(inside)
        assert looked[a, leaf[b]].all()
        read = (looked * np.bincount(leaf, minlength=tree.leaves)).sum() / (200 * 4000)
        assert read < 0.6
