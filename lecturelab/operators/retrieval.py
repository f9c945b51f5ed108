"""Chunks and ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lecturelab.functions.text import let, strip, uni_and_bigrams
from lecturelab.functions.timecode import to_timecode
from lecturelab.operators.intervals import neighbour_chunks
from lecturelab.operators.ordered import BLOCK_ROWS, block_of, dense_index, joined_text, running, top_n
from lecturelab.operators.termvectors import fit, hashed_words, lecture_sizes, squared_lengths, weigh, word_postings
from lecturelab.params import RetrievalParams
from lecturelab.session import materialise


def segment_board_text(segments: DataFrame, boards: DataFrame) -> DataFrame:
    """`lecture_id, sid, board_text`: formulas of the segment's boards, blank line between; null without any."""
    ids = segments.select("lecture_id", "sid", F.explode("board_ids").alias("bid"))
    read = boards.where(F.coalesce("latex", F.lit("")) != "").select("lecture_id", "bid", "latex")
    return ids.join(read, ["lecture_id", "bid"]).groupBy("lecture_id", "sid").agg(
        joined_text(["bid"], "latex", "\n\n").alias("board_text"))


def chunk_windows(words: Column, target: int, overlap: int) -> Column:
    """Which positions of a segment form each chunk: `array<struct<lo, hi>>` over an array of word counts.

    Utterances are added until `target` words; then whole utterances worth `overlap` words are
    carried over. What is left at the end is one more chunk, even if it only repeats.
    """
    return let(words, lambda w: _fold_windows(w, target, overlap))


def _fold_windows(words: Column, target: int, overlap: int) -> Column:
    state = F.struct(
        F.lit(0).alias("lo"), F.lit(0).alias("words"), F.lit(0).alias("at"),
        F.array().cast("array<struct<lo:int,hi:int>>").alias("done"),
    )

    def carried(lo, at):
        # walk back from `at`, stop once `overlap` words are in; never before the window start
        back = F.reverse(F.slice(words, lo + 1, at - lo + 1))
        return F.aggregate(
            back, F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")),
            lambda s, w: F.when(s["words"] >= overlap, s).otherwise(
                F.struct((s["n"] + 1).alias("n"), (s["words"] + w).alias("words"))))

    def step(s, w):
        total = s["words"] + w
        kept = carried(s["lo"], s["at"])
        emitted = F.struct(
            (s["at"] + 1 - kept["n"]).alias("lo"), kept["words"].alias("words"), (s["at"] + 1).alias("at"),
            F.array_append(s["done"], F.struct(s["lo"].alias("lo"), s["at"].alias("hi"))).alias("done"))
        grown = F.struct(s["lo"].alias("lo"), total.alias("words"), (s["at"] + 1).alias("at"), s["done"].alias("done"))
        return F.when(total >= target, emitted).otherwise(grown)

    def finish(s):
        rest = F.array_append(s["done"], F.struct(s["lo"].alias("lo"), (s["at"] - 1).alias("hi")))
        return F.when(s["lo"] < s["at"], rest).otherwise(s["done"])

    return F.aggregate(words, state, step, finish)


def build_chunks(
    segments: DataFrame, utterances: DataFrame, boards_text: DataFrame | None = None,
    p: RetrievalParams = RetrievalParams(),
) -> DataFrame:
    """`lecture_id, cid, sid, start_s, title, text, board, n_utterances`.

    Only word counts are folded, one small integer array per segment; the texts are joined
    back by position. Segments are bounded by the segmentation, recordings are not.
    """
    ids = segments.select("lecture_id", "sid", F.posexplode("utterance_ids").alias("pos", "uid"))
    said = ids.join(utterances.select("lecture_id", "uid", "start_s", "text", "words"), ["lecture_id", "uid"])
    members = said.groupBy("lecture_id", "sid").agg(
        F.sort_array(F.collect_list(F.struct("pos", "words", "start_s", "text"))).alias("m"))
    windows = members.withColumn("_w", F.transform("m", lambda x: x["words"])).select(
        "lecture_id", "sid", "m", F.posexplode(chunk_windows(F.col("_w"), p.chunk_words, p.chunk_overlap)).alias("local", "win"))
    inside = F.slice("m", F.col("win.lo") + 1, F.col("win.hi") - F.col("win.lo") + 1)
    pieces = windows.select(
        "lecture_id", "sid", "local", F.get("m", F.col("win.lo"))["start_s"].alias("start_s"),
        F.array_join(F.transform(inside, lambda x: strip(x["text"])), " ").alias("text"),
        (F.col("win.hi") - F.col("win.lo") + 1).alias("n_utterances"))
    heads = segments.select("lecture_id", "sid", F.col("start_s").alias("_seg_start"), "title")
    out = pieces.join(heads, ["lecture_id", "sid"])
    if boards_text is None:
        out = out.withColumn("board", F.lit(None).cast("string"))
    else:
        out = out.join(boards_text.withColumnRenamed("board_text", "board"), ["lecture_id", "sid"], "left")
    out = dense_index(out, ["lecture_id"], ["sid", "local"], block_of(F.col("sid"), 4096), "cid")
    named = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(
        F.concat(F.lit("Фрагмент "), to_timecode(F.col("_seg_start"))))
    return out.select("lecture_id", "cid", "sid", "start_s", named.alias("title"), "text", "board", "n_utterances")


def searchable(chunks: DataFrame) -> DataFrame:
    """`lecture_id, row_id, text`: title, text and board of a chunk, empty parts skipped."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("title", "text", "board")]
    return chunks.select("lecture_id", F.col("cid").alias("row_id"), F.concat_ws("\n", *parts).alias("text"))


def sparse_scores(rows: DataFrame, questions: DataFrame, max_features: int | None = None, stored: bool = True) -> DataFrame:
    """`lecture_id, query_id, cid, score` of passages that share a term with the question.

    All questions are answered in one pass. Texts are taken apart once, into 64-bit hashes of their words, which `stored` writes to
    the shared folder, as they are read twice. The postings are shuffled once, packed into arrays (`squared_lengths`), to learn how
    many passages of the recording hold a term: that is what the lengths of the passages need. What the questions ask for is taken
    out by a join with the asked terms, which Spark broadcasts if they are few. A capped vocabulary takes the way over tables of terms.
    """
    if max_features is not None:
        return _capped_scores(rows, questions, max_features, stored)
    words = hashed_words(rows)
    if stored:
        words = materialise(words, "words")
    sizes = materialise(lecture_sizes(words), "sizes")  # stored, so that Spark knows how few they are
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    damped = 1.0 + F.log(F.col("tf"))

    own = questions.select("lecture_id", F.col("query_id").alias("row_id"), F.col("question").alias("text"))
    asked = word_postings(hashed_words(own)).groupBy("lecture_id", F.col("row_id").alias("query_id"), "h").agg(F.sum("tf").alias("tf"))
    asked = materialise(asked, "asked")
    met = materialise(word_postings(words).join(asked.select("lecture_id", "h").distinct(), ["lecture_id", "h"]), "met")
    known = met.groupBy("lecture_id", "h").agg(F.count(F.lit(1)).alias("df")).join(sizes, "lecture_id").select("lecture_id", "h", idf.alias("idf"))
    raw = asked.join(known, ["lecture_id", "h"]).withColumn("raw", damped * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("lecture_id", "query_id")))
    wanted = materialise(raw.select("lecture_id", "h", "query_id", (F.col("raw") / length * F.col("idf")).alias("qw")), "wanted")
    shared = met.join(wanted, ["lecture_id", "h"]).groupBy("lecture_id", "row_id", "query_id").agg(F.sum(damped * F.col("qw")).alias("dot"))

    norms = squared_lengths(words, sizes).groupBy("lecture_id", "row_id").agg(F.sqrt(F.sum("sq")).alias("norm"))
    # nine digits: sums do not depend on the order of addition, ties stay ties
    return shared.join(norms, ["lecture_id", "row_id"]).select(
        "lecture_id", "query_id", F.col("row_id").alias("cid"), F.round(F.col("dot") / F.col("norm"), 9).alias("score"))


def _capped_scores(rows: DataFrame, questions: DataFrame, max_features: int, stored: bool) -> DataFrame:
    """`sparse_scores` by the `max_features` most frequent terms of each recording; the terms themselves settle ties."""
    counts, vocab = fit(rows, max_features, stored)
    asked = questions.select("lecture_id", "query_id", F.explode(uni_and_bigrams(F.col("question"))).alias("term"))
    asked = asked.groupBy("lecture_id", "query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    wanted = weigh(asked, vocab, ["lecture_id", "query_id"], keep=("idf",)).select(
        "lecture_id", "term", "query_id", (F.col("w") * F.col("idf")).alias("qw"))
    damped = 1.0 + F.log(F.col("tf"))
    raw = counts.join(vocab.select("lecture_id", "term", "idf"), ["lecture_id", "term"]).select(
        "lecture_id", "row_id", (damped * F.col("idf")).alias("raw"))
    norms = raw.groupBy("lecture_id", "row_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    shared = counts.join(wanted, ["lecture_id", "term"]).groupBy("lecture_id", "row_id", "query_id").agg(
        F.sum(damped * F.col("qw")).alias("dot"))
    # nine digits: sums do not depend on the order of addition, ties stay ties
    return shared.join(norms, ["lecture_id", "row_id"]).select(
        "lecture_id", "query_id", F.col("row_id").alias("cid"), F.round(F.col("dot") / F.col("norm"), 9).alias("score"))


def dense_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Dot product of unit vectors: `lecture_id, query_id, cid, dense` for every chunk of the asked recording."""
    pairs = chunks.select("lecture_id", "cid", unit(F.col("embedding")).alias("v")).join(
        queries.select("lecture_id", "query_id", unit(F.col("embedding")).alias("q")), "lecture_id")
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("lecture_id", "query_id", "cid", F.round(dot, 9).alias("dense"))


def unit(v: Column) -> Column:
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.greatest(norm, F.lit(1e-8)))


def hybrid_scores(sparse: DataFrame, dense: DataFrame, weight: float = 0.5) -> DataFrame:
    """`(1 - w) * sparse + w * dense`, unrounded; a passage without a shared term has sparse score 0."""
    both = dense.join(sparse, ["lecture_id", "query_id", "cid"], "left")
    return both.select(
        "lecture_id", "query_id", "cid",
        ((1 - weight) * F.coalesce("score", F.lit(0.0)) + weight * F.col("dense")).alias("score"))


def search_topk(
    scores: DataFrame, questions: DataFrame, passages: DataFrame, k: int = 6, min_score: float = 0.05
) -> DataFrame:
    """`lecture_id, query_id, rank, cid, score`: the best `k` above `min_score`, else the single best.

    A question that shares no term with its recording gets the first passage with score 0.
    Equal scores go by the lower passage number.
    """
    best = top_n(
        scores, ["lecture_id", "query_id"], [F.desc("score"), F.asc("cid")], k, "rank", spread=["cid"], salts=16)
    best = best.where((F.col("score") > min_score) | (F.col("rank") == 1))
    firsts = passages.groupBy("lecture_id").agg(F.min("row_id").alias("first_cid"))
    asked = questions.select("lecture_id", "query_id").join(firsts, "lecture_id")
    return asked.join(best, ["lecture_id", "query_id"], "left").select(
        "lecture_id", "query_id", F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce("cid", "first_cid").alias("cid"), F.coalesce("score", F.lit(0.0)).alias("score"))


def expand_context(hits: DataFrame, chunks: DataFrame, p: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Hits and their neighbours, each chunk once, in time order, the first `max_context_chunks`."""
    near = neighbour_chunks(hits.select("lecture_id", "query_id", "cid"), chunks, p.neighbour_radius)
    once = near.drop("hit_cid").dropDuplicates(["lecture_id", "query_id", "cid"])
    order = Window.partitionBy("lecture_id", "query_id").orderBy("start_s", "cid")
    return once.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= p.max_context_chunks)


def transcript_filter(utterances: DataFrame, needle: str, limit: int = 1500) -> DataFrame:
    """First `limit` utterances of each recording that contain `needle`, ignoring case."""
    found = utterances.where(F.lower("text").contains(needle.lower()))
    return top_n(found, ["lecture_id"], [F.asc("uid")], limit, "pos", spread=["uid"])
