"""TF-IDF fitted per recording, as a long table `(lecture_id, row_id, term, w)`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lecturelab.functions.text import uni_and_bigrams, word_tokens
from lecturelab.operators.ordered import top_n
from lecturelab.session import materialise

TERMS_AT_ONCE = 1 << 20
WORDS_OF_PART = 1 << 19  # words of a recording for each part of its terms: about a million postings


def term_counts(rows: DataFrame) -> DataFrame:
    """`lecture_id, row_id, term, tf` from `lecture_id, row_id, text`.

    Texts are spread by row before they are taken apart, so the counts of a row are
    complete where they arise and the far larger token rows are not shuffled for them.
    """
    spread = rows.select("lecture_id", "row_id", "text").repartition("lecture_id", "row_id")
    terms = spread.select("lecture_id", "row_id", F.explode(uni_and_bigrams(F.col("text"))).alias("term"))
    return terms.groupBy("lecture_id", "row_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def hashed_counts(rows: DataFrame, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """`lecture_id, row_id, h, tf`: `term_counts` with 64-bit hashes for the terms, counted row by row where the text lies.

    Nothing is shuffled; a row's terms are sorted in numpy, some rows together up to `at_once` terms or one longer row.
    """
    hashes = F.transform(uni_and_bigrams(F.col("text")), lambda t: F.xxhash64(t))
    slim = rows.where(F.col("text").isNotNull()).select("lecture_id", "row_id", hashes.alias("h"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:2])
    return slim.mapInArrow(lambda batches: _counted(batches, at_once), f"{kinds}, h long, tf int")


def _counted(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("h")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - (ends[0] if len(ends) else 0)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + at_once, side="right")) - 1)
            term = lists.slice(at, upto - at).flatten().to_numpy()
            row = np.repeat(np.arange(at, upto), np.diff(ends[at: upto + 1]))
            order = np.lexsort((term, row))
            term, row = term[order], row[order]
            opens = np.ones(len(term), bool)
            opens[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(opens)
            own = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lecture_id").take(own), batch.column("row_id").take(own), pa.array(term[first], pa.int64()),
                 pa.array(np.diff(first, append=len(term)), pa.int32())], names=["lecture_id", "row_id", "h", "tf"])
            at = upto


def hashed_words(rows: DataFrame) -> DataFrame:
    """`lecture_id, row_id, words`: 64-bit hashes of the tokens of a text in order; null text has none. Texts are taken apart here only."""
    words = F.transform(word_tokens(F.col("text"), 2), lambda t: F.xxhash64(t))
    return rows.select("lecture_id", "row_id", F.coalesce(words, F.array().cast("array<bigint>")).alias("words"))


def word_postings(words: DataFrame) -> DataFrame:
    """`lecture_id, row_id, h, tf` of the tokens and pairs of neighbouring tokens in `words`; nothing is shuffled."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields[:2])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, term, tf in _terms_of(batch.column("words")):
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lecture_id").take(own), batch.column("row_id").take(own), pa.array(term), pa.array(tf)],
                    names=["lecture_id", "row_id", "h", "tf"])

    return words.select("lecture_id", "row_id", "words").mapInArrow(flat, f"{kinds}, h long, tf int")


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    a, b = first.view(np.uint64), second.view(np.uint64)
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _terms_of(lists: pa.ListArray, at_once: int = TERMS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, term, count) by row, then term; some rows together up to `at_once` words, or one longer row."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - (ends[0] if len(ends) else 0)
    at = 0
    while at < len(lists):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + at_once, side="right")) - 1)
        word = lists.slice(at, upto - at).flatten().to_numpy()
        row = np.repeat(np.arange(at, upto), np.diff(ends[at: upto + 1]))
        next_to = np.flatnonzero(row[1:] == row[:-1])
        term = np.concatenate([word, _pair_hashes(word[next_to], word[next_to + 1])])
        row = np.concatenate([row, row[next_to]])
        order = np.lexsort((term, row))
        term, row = term[order], row[order]
        opens = np.ones(len(term), bool)
        opens[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(opens)
        yield row[first], term[first], np.diff(first, append=len(term)).astype(np.int32)
        at = upto


@F.pandas_udf(LongType())
def _hash_of_words(words: pd.Series) -> pd.Series:
    return pd.Series([w[0] if len(w) == 1 else _pair_hashes(w[:1], w[1:])[0] for w in words], dtype="int64")


def term_hash(term: Column) -> Column:
    """The hash that `word_postings` gives a term: a token, or two with a space between."""
    return _hash_of_words(F.transform(F.split(term, " "), lambda t: F.xxhash64(t)))


def lecture_sizes(words: DataFrame) -> DataFrame:
    """`lecture_id, n, parts`: passages of a recording, and into how many parts its terms are dealt."""
    return words.groupBy("lecture_id").agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.sum(F.size("words")) / WORDS_OF_PART), F.lit(1)).cast("int").alias("parts"))


def _packed(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """`lecture_id, part, n, row_id, h, tf`: the postings of some passages in one part of a recording's terms, as arrays."""
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lecture = batch.column("lecture_id").dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
            parts = batch.column("parts").to_numpy()
            for row, term, tf in _terms_of(batch.column("words")):
                if not len(row):
                    continue
                part = (term.view(np.uint64) % parts[row].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((part, lecture[row]))
                row, term, tf, part = row[order], term[order], tf[order], part[order]
                opens = np.ones(len(row), bool)
                opens[1:] = (part[1:] != part[:-1]) | (lecture[row[1:]] != lecture[row[:-1]])
                first = np.flatnonzero(opens)
                edges = pa.array(np.append(first, len(row)).astype(np.int32))
                own = pa.array(row[first])
                packed = [pa.ListArray.from_arrays(edges, v) for v in (batch.column("row_id").take(pa.array(row)), pa.array(term), pa.array(tf))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lecture_id").take(own), pa.array(part[first].astype(np.int32)), batch.column("n").take(own), *packed],
                    names=["lecture_id", "part", "n", "row_id", "h", "tf"])

    told = words.select("lecture_id", "row_id", "words").join(sizes, "lecture_id")
    return told.mapInArrow(
        pack, f"lecture_id {kinds['lecture_id']}, part int, n long, row_id array<{kinds['row_id']}>, h array<long>, tf array<int>")


def _unpacked(group: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row_id, term, count, how many passages have the term, squared raw weight) of a part, by term."""
    flat = lambda name: group.column(name).combine_chunks().flatten()
    term, tf = flat("h").to_numpy(), flat("tf").to_numpy()
    order = np.argsort(term, kind="stable")
    term, tf = term[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    runs = np.diff(first, append=len(term))
    df = np.repeat(runs, runs)
    idf = np.log((1.0 + group.column("n")[0].as_py()) / (1.0 + df)) + 1.0
    return flat("row_id").take(pa.array(order)), term, tf, df, ((1.0 + np.log(tf)) * idf) ** 2


def squared_lengths(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """`lecture_id, row_id, sq`: parts of the squared length of each passage, one for each part of the terms that it meets.

    The postings are shuffled once, packed into arrays, to learn how many passages hold a term. A task holds one
    part of a recording's terms, about a million postings, or one term with all its passages.
    """
    def add(group: pa.Table) -> pa.Table:
        rows, _, _, _, square = _unpacked(group)
        coded = rows.dictionary_encode()
        sums = np.bincount(coded.indices.to_numpy(), square, len(coded.dictionary))
        return pa.table({"lecture_id": pa.repeat(group.column("lecture_id")[0], len(sums)), "row_id": coded.dictionary, "sq": sums})

    packed = _packed(words, sizes)
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    return packed.groupBy("lecture_id", "part").applyInArrow(add, f"lecture_id {kinds['lecture_id']}, row_id {kinds['row_id']}, sq double")


def postings_by_term(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """`lecture_id, h, df, row_id, tf, n`, by `h` inside each part of a recording's terms; shuffled once, packed into arrays."""
    def unpack(group: pa.Table) -> pa.Table:
        rows, term, tf, df, _ = _unpacked(group)
        same = lambda name: pa.repeat(group.column(name)[0], len(term))
        return pa.table({"lecture_id": same("lecture_id"), "h": term, "df": df.astype(np.int32), "row_id": rows, "tf": tf, "n": same("n")})

    packed = _packed(words, sizes)
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    return packed.groupBy("lecture_id", "part").applyInArrow(
        unpack, f"lecture_id {kinds['lecture_id']}, h long, df int, row_id {kinds['row_id']}, tf int, n long")


def vocabulary(rows: DataFrame, counts: DataFrame, max_features: int | None = None) -> DataFrame:
    """`lecture_id, term, df, idf`; the `max_features` most frequent terms, ties in term order.

    The counts are aggregated before the cap, and the cap is taken slice by slice, so a
    recording with a huge vocabulary does not end in one task.
    """
    terms = counts.groupBy("lecture_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if max_features is not None:
        terms = most_frequent(terms, max_features)
    sizes = rows.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(sizes, "lecture_id").select(
        "lecture_id", "term", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def most_frequent(terms: DataFrame, limit: int) -> DataFrame:
    """The `limit` terms of each recording with the largest `total`, ties in term order.

    A histogram of the totals tells which totals are in, which are out, and which one is cut;
    only the terms at the cut are ranked. A recording within the limit is never sorted.
    """
    falling = Window.partitionBy("lecture_id").orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0)
    hist = terms.groupBy("lecture_id", "total").agg(F.count(F.lit(1)).alias("_same"))
    room = hist.withColumn("_room", limit - F.sum("_same").over(falling) + F.col("_same")).where("_room > 0")
    fits = F.col("_same") <= F.col("_room")
    whole = terms.join(room.where(fits).select("lecture_id", "total"), ["lecture_id", "total"])
    # usually nothing is cut; the empty side then ends this branch at run time
    cut = top_n(terms.join(room.where(~fits), ["lecture_id", "total"]), ["lecture_id"], [F.asc("term")], limit, "_rank", spread=["term"])
    return whole.unionByName(cut.where(F.col("_rank") <= F.col("_room")).drop("_same", "_room", "_rank"))


def raw_weights(counts: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts with `raw`, `(1 + ln tf) * idf`, and the `keep` columns of the vocabulary."""
    known = vocab.select(*dict.fromkeys(("lecture_id", "term", "idf", *keep)))
    return counts.join(known, ["lecture_id", "term"]).withColumn("raw", (1.0 + F.log(F.col("tf"))) * F.col("idf"))


def weigh(counts: DataFrame, vocab: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """L2-normalised `(1 + ln tf) * idf` per row (`keys`, `term`, `w`) and the `keep` columns of the vocabulary."""
    raw = raw_weights(counts, vocab, keep)
    # the terms of one text: a bounded window
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("raw") / norm).alias("w"), *keep)


def fit(rows: DataFrame, max_features: int | None = None, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(term counts, vocabulary) of `rows`. `stored` writes the counts to the shared folder first.

    Counts are read by the vocabulary and again by whatever weighs them, so anything that
    goes on from here should store them: the texts are then taken apart once.
    """
    counts = term_counts(rows)
    if stored:
        counts = materialise(counts, "term-counts")
    return counts, vocabulary(rows, counts, max_features)


def tfidf(rows: DataFrame, max_features: int | None = None, stored: bool = False) -> DataFrame:
    return weigh(*fit(rows, max_features, stored), ["lecture_id", "row_id"])
