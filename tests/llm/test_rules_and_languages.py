"""Quality rules against plain loops; the random field against enumeration and held-out labels."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lecturelab.llm import langid, quality_rules
from lecturelab.llm.queries import op2

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


def expected(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


def test_figures_match_plain_loops(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\n\x0b\f\r", "a", "x " * 40, "one two three four five six seven eight " * 2, "\n\n a \n a \n\ta\n", "é ü # | <b>", "the of and"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [rng.choice(["\n", "\r\n", " "]).join(rng.choice(["the of and to", "ab#c", "", "word " * 9]) for _ in range(rng.randrange(30))) for _ in range(40)]
    texts.append("long " + " ".join(str(k % 7001) for k in range(30_000)))
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in quality_rules.score(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected(t), (i, t)
        assert not (r["base_failed"] and r["kept"])


def test_rules_keep_rows_whole(spark):
    good = "The thing of it is that a text with many common words and the usual marks is kept by all of the rules here."
    rows = [(1, good, "en", "s", 5, True), (1, good, "en", "s", 5, True), (None, good, None, None, None, None), (2, "x", "en", "s", 1, False)]
    df = spark.createDataFrame(rows, DOC + ", n_words int, kept boolean")
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r["text"] == good)
    assert quality_rules.keep(df.limit(0)).count() == 0
    assert quality_rules.score(df.limit(0)).count() == 0


def test_scores_can_be_filtered_and_joined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = quality_rules.score(docs)
    rows = scores.collect()
    assert scores.where("kept").count() == sum(r["kept"] for r in rows)
    assert scores.where("n_words > 100 and kept").count() == sum(r["kept"] and r["n_words"] > 100 for r in rows)
    sizes = spark.createDataFrame([(n,) for n in {r["n_words"] for r in rows}], "n_words long")
    assert scores.join(sizes, "n_words").count() == len(rows)


def test_forward_backward_matches_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    lengths = np.array([5, 1, 7, 2])
    scores, moves = rng.normal(size=(15, 3)), rng.normal(size=(3, 3))
    for block in (64, 3, 2):
        monkeypatch.setattr(langid, "BLOCK", block)
        got, at = langid.marginals(scores, lengths, moves), 0
        for n in lengths:
            own, want = scores[at:at + n], np.zeros((n, 3))
            for path in itertools.product(range(3), repeat=int(n)):
                w = np.exp(sum(own[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
                for t, y in enumerate(path):
                    want[t, y] += w
            assert np.allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True))
            at += n


def test_pair_probabilities_match_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    chance = langid.marginals(scores, np.array([4]), moves)
    want = np.zeros((3, 3))
    total = 0.0
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += w
        for a, b in itertools.pairwise(path):
            want[a, b] += w
    assert np.allclose(langid.pairs(scores, chance, np.array([1, 2, 3]), moves), want / total, atol=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), params=langid.CrfParams(rounds=15))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(langid.held_out(F.col("doc_id")))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_mixed_text_is_labelled_word_by_word(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 600").collect()}
    parts = [docs["en"].split()[:40], docs["de"].split()[:20], docs["en"].split()[40:60]]
    found = langid.predict_batch([" ".join(w for p in parts for w in p)], model).iloc[0]
    assert found["lang_pred"] == "en" and 2 <= found["n_switches"] <= 6 and 0.5 < found["score"] < 0.95


def test_language_edges(spark, model):
    rows = [(1, None, "en", "s", 1), (2, "12 34 --", "en", "s", 1), (3, "", None, None, None), (None, "the of and", "en", None, 2), (4, "the " * 50_000, "en", "s", 3), (4, "the " * 50_000, "en", "s", 3)]
    df = spark.createDataFrame(rows, DOC + ", score int")
    got = [tuple(r) for r in langid.identify(df, model).select("doc_id", "held_out", "lang_pred", F.round("score", 6)).collect()]
    assert [r[2] for r in got[:3]] == ["und"] * 3 and [r[3] for r in got[:3]] == [0.0] * 3
    assert got[3][:2] == (None, False) and got[4] == got[5]
    for r in got:
        assert r[0] is None or r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0)
    assert langid.keep(df, model).columns == df.columns
    assert langid.keep(df.limit(0), model).count() == 0
    nothing = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    one = langid.fit([("en", "only one language here")])
    assert set(langid.predict_batch(["some words", "1"], one)["lang_pred"]) == {"en", "und"}


def test_query_predicts_all_documents(spark):
    got = op2(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
