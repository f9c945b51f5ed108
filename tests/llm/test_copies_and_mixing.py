"""Fingerprints, links and components against plain loops; apportionment against its definition."""

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lecturelab.llm import components, mixing, neardup
from lecturelab.llm.queries import op4, op5

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_plain_loops(spark, monkeypatch):
    texts = [None, "", " \n", "a", "A b", "a B c", "É é   x\x0by", "w " * 500] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    for block in (1 << 16, 7):
        monkeypatch.setattr(neardup, "_BLOCK", block)
        assert [neardup.simhash(t) % (1 << 64) for t in texts] == [plain_fingerprint(t) for t in texts]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    got = df.select(neardup.fingerprint_text(neardup.fingerprint("text")).alias("f")).collect()
    assert [r["f"] for r in got] == [f"{plain_fingerprint(t):016x}" for t in texts]


def test_jvm_hash_is_the_same(spark):
    rows = spark.createDataFrame([("a b c",), ("é",), ("",)], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r["h"] % (1 << 64) == xxhash.xxh64_intdigest(r["t"].encode(), 42) for r in rows)


@pytest.mark.parametrize(("distance", "parts", "length"), [(2, 3, 2), (2, 4, 3), (3, 4, 2), (5, 4, 1)])
def test_links_are_complete(spark, distance, parts, length):
    rng = random.Random(distance * 100 + parts)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            v = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    got = neardup.links(spark.createDataFrame([(v,) for v in signed], "fp long"), "fp", distance, parts, length).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    links += links[:5] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups(links, {n for a, b in links for n in (a, b) if a != b})
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_match_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in op5(spark, SF).collect()}
    assert len(got) == docs.count()
    by_value = defaultdict(list)
    for k, (f, _) in got.items():
        by_value[f].append(k)
    values = sorted(by_value)
    own = groups([(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= 2], values)
    first = defaultdict(lambda: 1 << 60)
    for v in values:
        first[own[v]] = min(first[own[v]], *by_value[v])
    assert all(c == first[own[f]] for f, c in got.values())


def test_copies_and_edges(spark):
    long = " ".join(str(k) for k in range(30_000))
    rows = [(3, "a b c d", "en", "s", 1), (1, "A  B\nc d", "en", "s", 2), (2, None, None, None, None), (9, "", "en", "s", 3), (None, "a b c d", "en", "s", 4), (7, long, "en", "s", 5), (8, long + " x", "en", "s", 6), (3, "a b c d", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOC + ", fp int")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in neardup.clusters(df).collect()))
    assert got == [(0, 1), (1, 1), (2, 2), (3, 1), (3, 1), (7, 7), (8, 7), (9, 2)]
    kept = neardup.deduplicate(df)
    assert sorted(kept.columns) == sorted(df.columns)
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [1, 2, 7]  # a copy without an id is a copy
    assert neardup.clusters(df.limit(0)).count() == 0 and neardup.deduplicate(df.limit(0)).count() == 0


def highest_quotients(due, house, limits):
    seats = [0] * len(due)
    for _ in range(house):
        open_ = [i for i in range(len(due)) if seats[i] < limits[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (due[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(5)
    for _ in range(200):
        due = [float(rng.choice([0, rng.randrange(1, 400), 50])) for _ in range(rng.randrange(1, 9))]
        house = rng.randrange(0, 120)
        assert mixing.apportion(due, house, [10_000] * len(due)) == (highest_quotients(due, house, [10_000] * len(due)) if sum(due) else [0] * len(due))


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.choice([0, rng.randrange(1000)]) for _ in range(rng.randrange(1, 12))]
        due = mixing.targets(sizes)
        assert abs(sum(due) - 1.5 * sum(sizes)) < 1e-6 and all(d <= 2 * s + 1e-9 for d, s in zip(due, sizes, strict=True))
        free = [d / (3, 1, 2)[i % 3] for i, (d, s) in enumerate(zip(due, sizes, strict=True)) if d < 2 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def test_shard_quotas_add_up():
    params = mixing.MixParams(shards=5)
    due = mixing.targets([900, 77, 1234, 5])
    blocks = [-(-s // params.block_words) for s in (900, 77, 1234, 5)]
    quotas = mixing.shard_quotas(due, blocks, params)
    assert all(q >= 0 for row in quotas for q in row)
    assert [sum(c) for c in zip(*quotas, strict=True)] == mixing.apportion(due, round(sum(due) / 8), [2 * b for b in blocks])
    for own, n in zip(zip(*quotas, strict=True), blocks, strict=True):
        runs = mixing.block_runs(own, n, 3 % n)
        assert sum(hi - lo for _, _, lo, hi in runs) == sum(own) and all(0 <= lo < hi <= n for _, _, lo, hi in runs)
        for p in {r[1] for r in runs}:  # no block twice in a pass
            taken = [b for _, q, lo, hi in runs if q == p for b in range(lo, hi)]
            assert len(taken) == len(set(taken))


def test_mix(spark):
    got = {r["doc_id"]: r for r in op4(spark, SF).collect()}
    again = {r["doc_id"]: r["taken"] for r in op4(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken, target = defaultdict(int), {}
    for d in docs.collect():
        r = got[d["doc_id"]]
        assert r["size"] == len(d["text"].encode().split())
        assert 0 <= r["taken"] <= 2 * r["size"] and again[d["doc_id"]] == r["taken"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    pieces = mixing.pieces(docs)
    assert {r[0]: r[1] for r in pieces.groupBy("doc_id").agg(F.sum("n_words")).collect()} == {k: v for k, v in again.items() if v}
    assert pieces.join(docs.select("doc_id", mixing.n_words(F.col("text")).alias("s")), "doc_id").where("from_word < 0 or from_word + n_words > s").count() == 0


def test_mix_edges(spark):
    rows = [(1, "a b c", "en", None, 1), (2, None, "en", "s", 2), (None, "x " * 100, "en", "s", 3), (None, "x " * 100, "en", "s", 3), (3, "y " * 50, "en", "t", 4), (3, "y " * 50, "en", "t", 4), (4, "", "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOC + ", size int")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == 7 and {r["source_size"] for r in rows} == {0, 3, 100, 200}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0
    none = mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in none)


def test_mix_hot_source_in_small_buckets(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rows = mixing.placed(df).orderBy("source", "start", "size").collect()
    ends = {}
    for r in rows:  # the line of a source has no gap and no overlap
        assert r["start"] == ends.get(r["source"], 0)
        ends[r["source"]] = r["start"] + r["size"]
    assert len(rows) == 3000 and sum(ends.values()) > 0


def test_the_line_of_a_source_does_not_depend_on_other_rows(spark):
    few = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("own").alias("source"))
    many = spark.range(100, 9000).select(F.col("id").alias("doc_id"), F.lit("d").alias("text"), F.lit("other").alias("source"))
    line = lambda df: [r["doc_id"] for r in mixing.placed(df).where("source = 'own'").orderBy("start").collect()]
    assert line(few) == line(few.unionByName(many)) != sorted(line(few))
