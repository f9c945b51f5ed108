"""A search index that outlives a call: stored postings, cells of vectors, exact best passages for batches of questions.

The index keeps how often a passage holds a term, by 64-bit hashes of terms, and the length of each passage. A batch of
questions reads the postings of its own terms; they give the sparse scores of all passages that share a term, and nothing else is
read for them. Passages lie in blocks: neighbours in a recording, or, where they have vectors, cells around a few of them, with
their centre and the least product of a member with it. With vectors a batch first bounds each (question, block): the
largest sparse score in the block and the cosine of the angle to the centre less the block's widest angle. The
`first_blocks` best blocks are scored exactly; their k-th score is a floor, and only blocks whose bound reaches it are
scored as well. So no question meets every vector, and what comes out is what a full comparison gives.

All joins are on `(recording, block)` or `(recording, term)`; a recording of any size is many blocks and many parts of terms. Texts
are read when the index is built and never again; their postings are shuffled once, packed into arrays. Tables are plain
Parquet under one path: `postings` (by term inside a part of a recording's terms), `rows`, `blocks`. A capped vocabulary is chosen
by the terms themselves and their hashes are kept.

Edge cases: a passage without a vector, or a question without one, has dense score 0; a question without a known term has
sparse score 0; a recording without passages answers nothing; equal scores go to the lower passage number; scores are
rounded to nine digits before they are compared, so they do not depend on the order of addition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lecturelab.operators.ordered import top_n
from lecturelab.operators.retrieval import unit
from lecturelab.operators.termvectors import fit, hashed_words, lecture_sizes, postings_by_term, term_hash, word_postings
from lecturelab.session import materialise, scratch_path

BLOCK_PASSAGES = 64
CELLS = 256
_SLACK = 1e-6
_ASKED = ["lecture_id", "query_id"]


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(spark, path)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cells(vectors: DataFrame, cells: int) -> tuple[DataFrame, DataFrame]:
    """(`lecture_id, row_id, v, block, near`, `lecture_id, block, centre`): passages with the nearest of about sqrt(n) of them.

    Centres are the passages with the smallest hashes, at most `cells` of a recording; any choice gives right bounds.
    """
    v = materialise(vectors.select("lecture_id", "row_id", unit(F.col("embedding")).alias("v")), "unit-vectors")
    sizes = v.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("n"))
    drawn = top_n(v.withColumn("_h", F.xxhash64("row_id")), ["lecture_id"], [F.asc("_h"), F.asc("row_id")], cells, "block", spread=["row_id"])
    centres = drawn.join(sizes, "lecture_id").where(F.col("block") <= F.ceil(F.sqrt("n"))).select("lecture_id", "block", F.col("v").alias("centre"))
    centres = materialise(centres, "centres")
    listed = centres.groupBy("lecture_id").agg(F.collect_list(F.struct("block", "centre")).alias("_c"))  # at most `cells`
    best = F.array_max(F.transform("_c", lambda c: F.struct(dot(F.col("v"), c["centre"]).alias("near"), (-c["block"]).alias("place"))))
    placed = v.join(listed, "lecture_id").withColumn("_b", best)
    return placed.select("lecture_id", "row_id", "v", (-F.col("_b.place")).alias("block"), F.col("_b.near").alias("near")), centres


def build_index(
    rows: DataFrame, path: str | None = None, vectors: DataFrame | None = None, max_features: int | None = None,
    block_passages: int = BLOCK_PASSAGES, cells: int = CELLS,
) -> SearchIndex:
    """Index of `rows` (`lecture_id, row_id, text`) and `vectors` (`lecture_id, row_id, embedding`), stored under `path`."""
    spark = rows.sparkSession
    index = SearchIndex(spark, path or scratch_path(spark, "index"))

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{index.path}/{name}")
        return index.table(name)

    words = materialise(hashed_words(rows), "words")
    postings = postings_by_term(words, materialise(lecture_sizes(words), "sizes"))
    if max_features is not None:
        kept = fit(rows, max_features, stored=True)[1].select("lecture_id", term_hash(F.col("term")).alias("h"))
        postings = postings.join(kept, ["lecture_id", "h"], "left_semi")
    postings = store(postings, "postings")
    lengths = postings.groupBy("lecture_id", "row_id").agg(F.sqrt(F.sum(_raw() * _raw())).alias("length"))
    numbered = words.select("lecture_id", "row_id").join(lengths, ["lecture_id", "row_id"], "left")
    if vectors is None:
        placed = numbered.withColumn("block", F.floor(F.col("row_id") / block_passages).cast("int"))
        placed = store(placed.withColumns({"v": F.lit(None).cast("array<double>"), "near": F.lit(None).cast("double")}), "rows")
        centres = None
    else:
        near, centres = _cells(vectors, cells)
        # block 0 holds what has no vector
        placed = store(numbered.join(near, ["lecture_id", "row_id"], "left").withColumn("block", F.coalesce("block", F.lit(0))), "rows")
    blocks = placed.groupBy("lecture_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.min("near").alias("widest"))
    if centres is None:
        blocks = blocks.withColumn("centre", F.lit(None).cast("array<double>"))
    else:
        blocks = blocks.join(centres, ["lecture_id", "block"], "left")
    store(blocks, "blocks")
    return index


def _idf() -> Column:
    return F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0


def _raw() -> Column:
    """Weight of a posting before the length of its passage."""
    return (1.0 + F.log(F.col("tf"))) * _idf()


def _counted(questions: DataFrame) -> DataFrame:
    """`lecture_id, query_id, h, times`: how often a question holds a term."""
    own = questions.select("lecture_id", F.col("query_id").alias("row_id"), F.col("question").alias("text"))
    return word_postings(hashed_words(own)).groupBy("lecture_id", F.col("row_id").alias("query_id"), "h").agg(F.sum("tf").alias("times"))


def _met(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """The postings of the asked terms."""
    return index.table("postings").join(asked.select("lecture_id", "h").distinct(), ["lecture_id", "h"])


def _weighed(counted: DataFrame, met: DataFrame) -> DataFrame:
    known = met.groupBy("lecture_id", "h").agg(F.max("n").alias("n"), F.max("df").alias("df"))
    raw = counted.join(known, ["lecture_id", "h"]).withColumn("raw", (1.0 + F.log(F.col("times"))) * _idf())
    # the terms of one question: a bounded window
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*_ASKED)))
    return raw.select(*_ASKED, "h", (F.col("raw") / length).alias("qw"))


def asked_terms(index: SearchIndex, questions: DataFrame) -> DataFrame:
    """`lecture_id, query_id, h, qw`: unit weights of the questions' known terms."""
    counted = _counted(questions)
    return _weighed(counted, _met(index, counted))


def _sparse(index: SearchIndex, asked: DataFrame, met: DataFrame) -> DataFrame:
    """`lecture_id, query_id, row_id, block, s`: the sparse scores of all passages that share a term."""
    sums = met.join(asked, ["lecture_id", "h"]).groupBy(*_ASKED, "row_id").agg(F.sum(F.col("qw") * _raw()).alias("_dot"))
    lengths = index.table("rows").select("lecture_id", "row_id", "block", "length")
    return sums.join(lengths, ["lecture_id", "row_id"]).select(*_ASKED, "row_id", "block", F.round(F.col("_dot") / F.col("length"), 9).alias("s"))


def _bounds(index: SearchIndex, asked: DataFrame, vectors: DataFrame | None, weight: float, scores: DataFrame | None = None) -> DataFrame:
    """`lecture_id, query_id, block, bound`: no passage of the block scores more. Blocks that can only score 0 are left out
    where there are no vectors. `scores` are the sparse scores, if they are known."""
    scores = _sparse(index, asked, _met(index, asked)) if scores is None else scores
    sparse = scores.groupBy(*_ASKED, "block").agg(F.max("s").alias("s"))
    if vectors is None:
        return sparse.select(*_ASKED, "block", (F.col("s") + _SLACK).alias("bound"))
    every = vectors.join(index.table("blocks"), "lecture_id")
    between = F.acos(F.greatest(F.least(dot(F.col("q"), F.col("centre")), F.lit(1.0)), F.lit(-1.0)))
    around = F.acos(F.greatest(F.least(F.col("widest"), F.lit(1.0)), F.lit(-1.0)))
    best = F.coalesce(F.cos(F.greatest(between - around, F.lit(0.0))), F.lit(0.0))
    # a zero vector scores 0 wherever it lies
    dense = every.select(*_ASKED, "block", F.greatest(best, F.lit(0.0)).alias("d"))
    both = dense.join(sparse, [*_ASKED, "block"], "left")
    return both.select(*_ASKED, "block", ((1 - weight) * F.coalesce("s", F.lit(0.0)) + weight * F.col("d") + _SLACK).alias("bound"))


def _scored(index: SearchIndex, chosen: DataFrame, scores: DataFrame, vectors: DataFrame, weight: float) -> DataFrame:
    """`lecture_id, query_id, cid, score` of the passages in `chosen` (`lecture_id, query_id, block`) blocks."""
    inside = chosen.join(vectors, _ASKED).join(index.table("rows").select("lecture_id", "block", "row_id", "v"), ["lecture_id", "block"])
    dense = inside.select(*_ASKED, "row_id", F.round(F.coalesce(dot(F.col("q"), F.col("v")), F.lit(0.0)), 9).alias("d"))
    both = dense.join(scores.drop("block"), [*_ASKED, "row_id"], "left")
    total = (1 - weight) * F.coalesce("s", F.lit(0.0)) + weight * F.col("d")
    return both.select(*_ASKED, F.col("row_id").alias("cid"), F.round(total, 9).alias("score"))


def best_passages(
    index: SearchIndex, questions: DataFrame, k: int = 6, vectors: DataFrame | None = None, weight: float = 0.5, first_blocks: int = 2,
) -> DataFrame:
    """`lecture_id, query_id, cid, score, rank`: exactly the first `k` passages of each question of a batch.

    `questions` has `lecture_id, query_id, question`; with `vectors` (`lecture_id, query_id, embedding`) the score is
    `(1 - weight) * sparse + weight * dense`. Without vectors only passages that share a term have a score.
    """
    counted = materialise(_counted(questions), "asked")
    met = materialise(_met(index, counted), "met")
    asked = materialise(_weighed(counted, met), "asked-weights")
    scores = _sparse(index, asked, met)
    ranking = [F.desc("score"), F.asc("cid")]
    if vectors is None:
        found = scores.select(*_ASKED, F.col("row_id").alias("cid"), F.col("s").alias("score"))
        return top_n(found, _ASKED, ranking, k, "rank", spread=["cid"], salts=16)
    scores = materialise(scores, "sparse")
    units = vectors.select(*_ASKED, unit(F.col("embedding")).alias("q"))
    vectors = materialise(questions.select(*_ASKED).join(units, _ASKED, "left"), "asked-vectors")
    bounds = materialise(_bounds(index, asked, vectors, weight, scores), "bounds")
    order = [F.desc("bound"), F.asc("block")]
    start = top_n(bounds, _ASKED, order, first_blocks, "_place", spread=["block"], salts=16).select(*_ASKED, "block")
    begun = materialise(_scored(index, start, scores, vectors, weight), "begun")
    kth = top_n(begun, _ASKED, ranking, k, "_place", spread=["cid"], salts=16).where(F.col("_place") == k).select(*_ASKED, F.col("score").alias("least"))
    open_blocks = bounds.join(start, [*_ASKED, "block"], "left_anti").join(kth, _ASKED, "left")
    reach = open_blocks.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select(*_ASKED, "block")
    found = begun.unionByName(_scored(index, materialise(reach, "reach"), scores, vectors, weight))
    return top_n(found, _ASKED, ranking, k, "rank", spread=["cid"], salts=16)


def search_index(
    index: SearchIndex, questions: DataFrame, k: int = 6, min_score: float = 0.05, vectors: DataFrame | None = None, weight: float = 0.5,
) -> DataFrame:
    """`lecture_id, query_id, rank, cid, score` as `retrieval.search_topk` gives: the best `k` above `min_score`, else the single best,
    else the first passage of the recording with score 0."""
    best = best_passages(index, questions, k, vectors, weight).where((F.col("score") > min_score) | (F.col("rank") == 1))
    firsts = index.table("blocks").groupBy("lecture_id").agg(F.min("first_row").alias("first_cid"))
    asked = questions.select(*_ASKED).join(firsts, "lecture_id")
    return asked.join(best, _ASKED, "left").select(
        *_ASKED, F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("cid", "first_cid").alias("cid"), F.coalesce("score", F.lit(0.0)).alias("score"))
