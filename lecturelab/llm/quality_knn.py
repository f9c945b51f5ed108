"""Quality of a text by its neighbours among labelled texts in a latent-semantic space.

Terms are hashed pairs of neighbouring bytes of the UTF-8 text and three of its layout (the percentage of words equal
to the one before, of repeated word windows, and of repeated lines). Counts are damped, weighted by inverse document
frequency over all documents, and projected on the leading singular vectors of a bounded sample of labelled texts. The
labelled vectors (at most about `train_texts` x `dimensions` numbers) are broadcast; every document is compared with
all of them, in blocks, by exact cosine products, and its `neighbours` nearest vote with their similarity.

Learning takes about `train_texts` labelled texts by a hash of the id; document frequencies take every document.

Edge cases: a null or empty text has no terms and no neighbours: its score is the share of label 1 among the labelled
texts; without labels every score is 0.5; labels that are null are ignored, of several for an id the highest counts;
rows without an id are scored and never learned from; very long texts are taken whole, in blocks; repeated rows are
scored alike; ties between equally near neighbours go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT = 3
_BLOCK = 1 << 22
_ROWS = 256


@dataclass(frozen=True)
class KnnParams:
    train_texts: int = 4096
    hashed_terms: int = 4096
    dimensions: int = 64
    neighbours: int = 25
    sharpness: int = 4
    threshold: float = 0.3
    window: int = 5
    layout_weight: float = 4.0
    seed: int = 42

    @property
    def terms(self) -> int:
        return self.hashed_terms + LAYOUT


@dataclass(frozen=True)
class KnnModel:
    params: KnnParams
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _places(params: KnnParams) -> np.ndarray:
    """The hashed term of every pair of bytes."""
    pair = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((pair >> np.uint64(33)) % np.uint64(params.hashed_terms)).astype(np.int64)


def counts(text: str | None, places: np.ndarray, params: KnnParams) -> np.ndarray:
    """Term counts of a whole text."""
    out = np.zeros(params.terms, np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data) - 1, _BLOCK):
        part = data[at: at + _BLOCK + 1].astype(np.int64)
        out[: params.hashed_terms] += np.bincount(places[part[:-1] * 256 + part[1:]], minlength=params.hashed_terms)
    words = text.split()
    windows = len(words) - params.window + 1
    if windows > 1:
        out[-3] = 100 * sum(map(eq, words, words[1:])) / len(words)
        out[-2] = 100 * (1 - len(set(zip(*(words[k:] for k in range(params.window)), strict=False))) / windows)
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[-1] = 100 * (1 - len(set(lines)) / len(lines))
    return out


def weighted(rows: np.ndarray, idf: np.ndarray, params: KnnParams) -> np.ndarray:
    out = np.log1p(rows) * idf
    out[:, params.hashed_terms:] *= params.layout_weight
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(norm > 1e-9, rows / np.where(norm > 1e-9, norm, 1), 0).astype(np.float32)


def document_frequencies(docs: DataFrame, text: str, params: KnnParams) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents; and how many hold any. Each task adds up its own first."""
    terms = params.terms

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, held, n = _places(params), np.zeros(terms, np.int64), 0
        for batch in batches:
            for t in batch["_text"]:
                row = counts(t, places, params) > 0
                held += row
                n += int(row.any())
        if n:
            yield pd.DataFrame({"term": np.arange(-1, terms), "n": np.concatenate([[n], held])})

    found = docs.select(F.col(text).alias("_text")).mapInPandas(add, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(terms + 1, np.int64)
    for r in found:
        out[r["term"] + 1] = r["n"]
    return out[1:], int(out[0])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def labelled_counts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, params: KnnParams) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of the sample, in the order of ids."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    total, scale = known.count(), 1 << 30
    rate = scale if total <= params.train_texts else scale * params.train_texts // total
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(params.seed)), F.lit(scale)) < rate)
    # about `train_texts` rows of an id and a label, whatever the corpus holds
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = _places(params)
        for batch in batches:
            rows = [counts(t, places, params) for t in batch["_text"]]
            yield pd.DataFrame({
                "id": batch["_id"], "label": batch["_label"],
                "terms": [np.flatnonzero(r).astype(np.int32).tobytes() for r in rows], "counts": [r[r > 0].tobytes() for r in rows]})

    id_type = chosen.schema["_id"].dataType.simpleString()
    found = texts.select("_id", "_label", "_text").mapInPandas(count, f"id {id_type}, label int, terms binary, counts binary").collect()
    found.sort(key=lambda r: (r["id"], r["terms"], r["counts"]))
    out = np.zeros((len(found), params.terms), np.float32)
    for i, r in enumerate(found):
        out[i, np.frombuffer(r["terms"], np.int32)] = np.frombuffer(r["counts"], np.float32)
    return out, np.array([r["label"] for r in found], np.float32)


def axes(rows: np.ndarray, params: KnnParams) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a seeded start."""
    k = min(params.dimensions, *rows.shape)
    basis = np.random.default_rng(params.seed).normal(size=(rows.shape[1], min(k + 8, *rows.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, inner = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ inner.T[:, :k]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", params: KnnParams = KnnParams()) -> KnnModel:
    held, n = document_frequencies(docs, text, params)
    idf = (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)
    rows, marks = labelled_counts(docs, labels, key, text, label, params)
    if not len(rows) or not rows.any():
        return KnnModel(params, idf, np.zeros((params.terms, 0), np.float32), np.zeros((0, 0), np.float32), marks)
    space = weighted(rows, idf, params)
    base = axes(space, params)
    return KnnModel(params, idf, base, _unit(space @ base), marks)


def vote(rows: np.ndarray, model: KnnModel) -> np.ndarray:
    """Scores of count rows."""
    prior = float(model.labels.mean()) if len(model.labels) else 0.5
    out = np.full(len(rows), prior)
    k = min(model.params.neighbours, len(model.vectors))
    if not k:
        return out
    own = _unit(weighted(rows, model.idf, model.params) @ model.axes)
    near = own @ model.vectors.T
    # the k nearest; a stable order settles ties by id
    edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
    above, level = near > edge, near == edge
    room = k - above.sum(axis=1, keepdims=True)
    chosen = above | (level & (np.cumsum(level, axis=1) <= room))
    weight = np.where(chosen, np.maximum(near, 0), 0).astype(np.float64) ** model.params.sharpness
    total = weight.sum(axis=1)
    some = total > 0
    out[some] = (weight[some] @ model.labels) / total[some]
    return np.clip(out, 0.0, 1.0)


def score_texts(docs: DataFrame, model: KnnModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # train_texts x dimensions, terms x dimensions

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        params = shared.value.params
        places = _places(params)
        for batch in batches:
            found = []
            for at in range(0, len(batch), _ROWS):
                found.append(vote(np.stack([counts(t, places, params) for t in batch[at: at + _ROWS]]), shared.value))
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(out, scored(F.col(text)))


def classify(docs: DataFrame, model: KnnModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, `held_out`, `score`, `predicted`."""
    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    predicted = F.when(F.col("score") >= model.params.threshold, 1).otherwise(0)
    return score_texts(slim, model, "_text").select(key, held_out(F.col(key)).alias("held_out"), "score", predicted.alias("predicted"))
