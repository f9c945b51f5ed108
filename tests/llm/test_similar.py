"""Similar texts of the pipeline's near-copy stage against plain loops."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lecturelab.llm import neardup

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    own = {k: plain_shingles(t) for k, t in rows}
    root = {k: k for k in own}
    for a in sorted(own):
        for b in sorted(own):
            both, whole = len(own[a] & own[b]), len(own[a] | own[b])
            if a < b and (5 * both >= 4 * whole):  # two empty sets are alike
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def replaced(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def test_near_copies_beyond_two_bits_go(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((len(rows), " ".join(base)))
        rows += [(len(rows) + k, " ".join(replaced(rng, base, max(1, len(base) // (40 + 8 * (k % 7)))))) for k in range(12)]
    bits = [(neardup.simhash(rows[13 * g][1]) ^ neardup.simhash(rows[13 * g + k][1])) % (1 << 64) for g in range(12) for k in range(1, 13)]
    assert sum(b.bit_count() > 2 for b in bits) > 100  # the two-bit rule leaves these
    rows += [(900, "a b"), (901, "A\nb"), (902, None), (903, " "), (904, "a b c"), (905, " ".join(map(str, range(30_000)))), (906, " ".join(map(str, range(25_000))))]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in rows] + [(None, "a b", "en", "s")], DOC)
    want = plain_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.similar_clusters(df).collect()}
    assert got == want | {None: 900}
    kept = corpus_pipeline.near_copies(spark, df, SF).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == sorted(set(want.values()))  # the row without an id is a copy of 900
    assert corpus_pipeline.near_copies(spark, df.limit(0), SF).count() == 0


def test_chains_across_a_band_are_whole(spark):
    """Texts that change a little at each step: the ends are strangers, the chain is one component."""
    rng = random.Random(4)
    chain = [[f"w{rng.randrange(9000)}" for _ in range(200)]]
    for _ in range(60):
        chain.append(replaced(rng, chain[-1], 3))
    rows = [(k, " ".join(words)) for k, words in enumerate(chain)]
    want = plain_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.similar_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 1


def test_sample_near_copies_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect()}
    assert kept == set(want.values())


def test_rows_decide_and_not_ids(spark):
    """An id that two different texts share decides for neither; a row without an id stays if its text is the only one."""
    other = " ".join(f"o{k}" for k in range(50))
    rows = [(1, " ".join(f"a{k}" for k in range(50)), "en", "s"), (1, other, "en", "s"), (2, other.upper(), "en", "s"), (None, "only here", "en", "s"), (None, "only  here", "en", "s"), (3, other, "en", "s")]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOC), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()[:2]) for r in kept) == [(0, "on"), (1, "a0"), (1, "o0")]


def pairs_found(got, similar):
    return sum(got[a] == got[b] for a, b in similar) / len(similar)


def test_drawn_members_find_what_all_pairs_find(spark):
    """A group whose texts are mostly just about similar, and one of templates, of which none is: the same components."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near = [(k, " ".join(replaced(rng, base, 2 + k % 3))) for k in range(300)]
    other = [f"v{rng.randrange(5000)}" for _ in range(200)]
    template = [(1000 + k, " ".join(replaced(rng, other, 6))) for k in range(150)]
    df = spark.createDataFrame(near + template, "doc_id long, text string")
    sets = {k: plain_shingles(t) for k, t in near + template}
    similar = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    drawn, exact = ({r["doc_id"]: r["component_id"] for r in neardup.similar_clusters(df, exact=e).collect()} for e in (False, True))
    assert pairs_found(exact, similar) == 1 and pairs_found(drawn, similar) >= 0.99
    assert {drawn[k] for k, _ in template} == {k for k, _ in template}


def test_pairs_grow_with_the_texts(spark):
    """Templates: alike in many bands, similar nowhere. Twice the texts make about twice the pairs, not four times."""
    made = []
    for n in (100, 200):
        rng = random.Random(5)
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        df = spark.createDataFrame([(k, " ".join(replaced(rng, base, 5))) for k in range(n)], "doc_id long, text string")
        own = df.select(neardup.words_hash("text").alias("fp"), neardup.text_bands("text").alias("bands"))
        members = own.select("fp", F.explode("bands").alias("band")).distinct()
        none = spark.createDataFrame([], "node long, label long")
        made.append((neardup._sent(members, none).count(), neardup._crossed(members, none).count()))
    (drawn, crossed), (drawn_2, crossed_2) = made
    assert drawn_2 < 2.7 * drawn and crossed_2 > 3.2 * crossed


def test_the_pipeline_s_stage_links_by_fingerprints_too(spark):
    """Texts of one repeated phrase have one fingerprint, whatever their ends; their five-word sets differ."""
    import corpus_pipeline

    ends = [" ".join(f"end{k}x{n}" for n in range(12)) for k in range(3)]
    rows = [(k, "one two three " * 100 + end) for k, end in enumerate(ends)] + [(7, "an own text of some other words that nobody repeats here"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({neardup.simhash(t) for _, t in rows[:3]}) == 1
    assert {r.doc_id for r in neardup.similar_only_once(docs).collect()} == {0, 1, 2, 7, 8}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {0, 7, 8}
