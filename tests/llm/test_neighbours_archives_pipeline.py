"""Classifier, archives and the pipeline."""

import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lecturelab.llm import decontaminate, langid, mixing, quality_knn, quality_rules, warc
from lecturelab.llm.common import table
from test_similar import plain_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return quality_knn.train(docs, labels)


def test_held_out_quality(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_knn.classify(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got["quality"] == 1]["score"], got[got["quality"] == 0]["score"]
    assert np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :]) > 0.97
    assert (got["predicted"] == (got["score"] >= 0.3)).all() and got["score"].between(0, 1).all()
    assert (got[got["quality"] == 1]["predicted"] == 1).mean() > 0.97


def test_votes_match_plain_loops(model):
    rng = np.random.default_rng(4)
    rows = rng.poisson(0.3, size=(20, model.params.terms)).astype(np.float32)
    got = quality_knn.vote(rows, model)
    for row, score in zip(rows, got, strict=True):
        own = quality_knn._unit(quality_knn.weighted(row[None], model.idf, model.params) @ model.axes)[0]
        near = model.vectors @ own
        best = np.argsort(-near, kind="stable")[: model.params.neighbours]
        w = np.maximum(near[best], 0).astype(float) ** model.params.sharpness
        assert abs(score - (w @ model.labels[best]) / w.sum()) < 1e-3


def test_counts_are_the_same_in_blocks(monkeypatch):
    params = quality_knn.KnnParams()
    places = quality_knn._places(params)
    text = "añb c\n" * 50
    whole = quality_knn.counts(text, places, params)
    monkeypatch.setattr(quality_knn, "_BLOCK", 7)
    assert (quality_knn.counts(text, places, params) == whole).all() and whole[:-3].sum() == len(text.encode()) - 1


def test_quality_edges(spark, model):
    rows = [(1, None, "en", "s", 1.0), (2, "", "en", "s", 1.0), (None, "the of", None, None, None), (3, "z " * 100_000, "en", "s", 0.0), (3, "z " * 100_000, "en", "s", 0.0)]
    df = spark.createDataFrame(rows, DOC + ", score double")
    got = quality_knn.classify(df, model).collect()
    prior = float(model.labels.mean())
    assert [r["score"] for r in got[:2]] == pytest.approx([prior, prior]) and got[3] == got[4] and got[2]["held_out"] is False
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    none = quality_knn.train(df, labels)
    assert {r["score"] for r in quality_knn.classify(df, none).collect()} == {0.5}
    assert quality_knn.classify(df.limit(0), quality_knn.train(df.limit(0), labels.limit(0))).count() == 0


PAGES = "page_id long, url string, html string, size int"


def pages_of(spark):
    rng = random.Random(8)
    big = "".join(rng.choice("abc é\r\n") for _ in range(700_000))
    rows = [(5, "http://a/", "x" * 100), (3, "http://b/", "x" * 100), (9, "http://c/", "x" * 100), (1, None, "x" * 99), (2, "u", "x" * 99), (4, "u\r\nWARC/1.1", None), (6, "é", ""),
            (7, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 3), (8, "u", big), (10, "u", big), (None, "n", "x" * 100), (None, None, "only here " * 20), (3, "http://b/", "x" * 100)]
    return [(a, b, c, 1) for a, b, c in rows]


@pytest.mark.parametrize("chunk", [warc.CHUNK_BYTES, 1000])
def test_archives_round_trip(spark, chunk):
    rows = pages_of(spark)
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    archives = warc.write_archives(warc.marked(df), warc.scratch_path(spark, "t"))
    chunks = warc.read_chunks(archives, chunk).collect()
    assert max(len(c["payload"]) for c in chunks) <= chunk and sum(c["last"] for c in chunks) == len(rows)
    first = {}
    for p, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", p)
    whole = defaultdict(list)
    for c in chunks:
        whole[c["archive"], c["record_no"]].append(c)
    seen = Counter()
    for own in whole.values():
        own.sort(key=lambda c: c["chunk_no"])
        assert [c["chunk_no"] for c in own] == list(range(len(own)))
        data = b""
        for c in own:
            data += bytes(c["payload"])
            assert c["payload_bytes"] == len(data) and c["payload_digest"] == hashlib.sha256(data).hexdigest()
        seen[own[0]["page_id"], own[0]["record_type"], own[0]["refers_to"], data if own[0]["record_type"] == "response" else b""] += 1
    want = Counter()
    for p, _, html, _ in rows:
        payload = (html or "").encode()
        to = first[html or ""] if len(payload) >= 100 and p is not None and first[html or ""] is not None and p > first[html or ""] else None
        want[p, "response" if to is None else "revisit", to, payload if to is None else b""] += 1
    assert seen == want
    got = warc.round_trip(df).collect()
    assert all(r["intact"] for r in got)
    sizes = {p: ((html or "").encode()) for p, _, html, _ in rows if p is not None}
    assert all(r["page_id"] is None or (r["payload_bytes"], r["payload_digest"]) == (len(sizes[r["page_id"]]), hashlib.sha256(sizes[r["page_id"]]).hexdigest()) for r in got)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_of_others_are_read():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 11\r\n\r\nhello\r\n\r\nyo\r\n\r\n"
    for data in (record * 2, gzip.compress(record) + gzip.compress(record), gzip.compress(record * 2)):
        rows = list(warc.chunks(pa.PythonFile(io.BytesIO(data), mode="r"), 4))
        assert [r["chunk_no"] for r in rows] == [0, 1, 2] * 2 and b"".join(r["payload"] for r in rows[:3]) == b"hello\r\n\r\nyo"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.chunks(pa.PythonFile(io.BytesIO(record[:-12]), mode="r")))


def test_pipeline_against_its_parts(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    df = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in quality_rules.score(df).where("kept").collect()}
    stage = df.where(F.col("doc_id").isin(sorted(kept)))
    crf = langid.train(stage)
    known = {r["doc_id"] for r in langid.identify(stage, crf).where("lang_pred <> 'und' and score >= 0.5").collect()}
    single = set(plain_components([(k, docs[k]["text"]) for k in sorted(known)]).values())  # the five-word rule
    leaked = {r["doc_id"] for r in decontaminate.leaks(df, table(spark, SF, "benchmark")).collect()}
    left = df.where(F.col("doc_id").isin(sorted(single - leaked)))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(left).where("taken > 0").collect()}
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, SF).collect()} == want and want


def test_pipeline_edges(spark):
    good = "The thing of it is that a text with many common words and the usual marks is kept by all of the rules here."
    rows = [(1, good, "en", "s"), (2, good, "en", "s"), (3, None, None, None), (4, good + " And more of it for a source without a name.", None, None), (None, good, "en", "s")]
    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
