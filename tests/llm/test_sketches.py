"""Every link of a band is found, by sketches that are compared in blocks."""

import random

import numpy as np
from pyspark.sql import functions as F

from lecturelab.llm import neardup
from test_similar import plain_components, plain_shingles, replaced


def two_halves(rng, n):
    """Two groups of texts, each similar inside; one text of each is similar to the other, all others are just not."""
    left, right = ([f"{c}{rng.randrange(9000)}" for _ in range(240)] for c in "lr")
    bridge = left + right
    other = [f"n{k}" if 60 <= k < 116 else w for k, w in enumerate(bridge)]  # 56 words in a row are others: 0.77
    near = [f"n{k}" if 60 <= k < 104 else w for k, w in enumerate(bridge)]  # 44 words: 0.82 of `bridge`, 0.95 of `other`
    rows = [replaced(rng, bridge, 2) for _ in range(n)] + [bridge] + [replaced(rng, other, 2) for _ in range(n)] + [near]
    return [(k, " ".join(words)) for k, words in enumerate(rows)]


def test_a_single_link_between_two_groups_is_found(spark):
    rows = [(1000 * g + k, text) for g in range(3) for k, text in two_halves(random.Random(g), 40)]
    want = plain_components(rows)
    assert len(set(want.values())) == 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.similar_clusters(df).collect()}
    assert got == want


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    rng = random.Random(2)
    for n in (1, 5, 40, 150, 900):
        one = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for k in (0, 1, n // 9, n // 3):
            a, b = (neardup.shingles(" ".join(t)) for t in (one, replaced(rng, one, k) + one[: k // 2]))
            bits = [np.frombuffer(neardup.sketch(h), np.uint8) for h in (a, b)]
            short = min(map(len, bits))
            while max(map(len, bits)) > short:
                bits = [x if len(x) == short else x[: len(x) // 2] ^ x[len(x) // 2:] for x in bits]
            assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(np.setxor1d(a, b))


def test_blocks_of_any_size_leave_no_similar_pair_out(spark, monkeypatch):
    """Texts of many lengths in one band: all similar pairs of different labels are left open, whatever the blocks."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(k, " ".join(replaced(rng, base[: rng.randrange(90, 300)], rng.randrange(0, 4)))) for k in range(70)]
    own = {k: plain_shingles(t) for k, t in rows}
    similar = {(a, b) for a in own for b in own if a < b and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])}
    texts = spark.createDataFrame(rows, "fp long, text string")
    sets = texts.select("fp", neardup.text_sets("text").alias("_s")).select("fp", "_s.*")
    shared = texts.select(F.lit(5).cast("long").alias("band"), "fp", F.lit(0).cast("long").alias("star"))
    none = spark.createDataFrame([], "node long, label long")
    assert len({len(neardup.sketch(neardup.shingles(t))) for _, t in rows}) > 1 and len(similar) > 100
    for most in (7, 1 << 12):
        monkeypatch.setattr(neardup, "MET_ROWS", most)
        found = {(r["a"], r["b"]) for r in neardup._sketched(shared, none, sets).collect()}
        assert similar <= found and len(found) < 0.7 * 70 * 69 / 2
