"""Joins between time spans of one recording.

Both sides are cut into fixed time buckets and joined on `(lecture_id, bucket)`, so a
long recording spreads over many tasks and no pair is looked at outside shared time.
A pair is kept only in its first shared bucket, hence no duplicate removal.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.functions.spans import span_is_valid, span_overlap
from lecturelab.functions.text import strip, truncate_words
from lecturelab.operators.ordered import BLOCK_ROWS, block_of, joined_text, running
from lecturelab.session import materialise

BUCKET_SECONDS = 60.0


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def _over_buckets(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))))


def split_valid_spans(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows): a span needs `0 <= start <= end`."""
    ok = span_is_valid(F.col("start_s"), F.col("end_s"))
    return df.where(ok), df.where(~ok)


def merge_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """Envelope of the spans of each key."""
    return df.groupBy(*keys).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def utterances_in(
    utterances: DataFrame, spans: DataFrame, min_overlap: float = 0.5, width: float = BUCKET_SECONDS
) -> DataFrame:
    """Utterances of which at least `min_overlap` of the own length lies in the span.

    `spans` has `lecture_id, span_start, span_end` and any further columns; utterances
    of zero length never match.
    """
    left = _over_buckets(utterances.where(F.col("end_s") > F.col("start_s")), "start_s", "end_s", width)
    right = _over_buckets(spans, "span_start", "span_end", width)
    first_shared = _bucket(F.greatest("start_s", "span_start"), width)
    share = span_overlap(F.col("start_s"), F.col("end_s"), F.col("span_start"), F.col("span_end")) / (
        F.col("end_s") - F.col("start_s"))
    return (
        left.join(right, ["lecture_id", "_bucket"])
        .where((F.col("_bucket") == first_shared) & (share >= min_overlap))
        .drop("_bucket")
    )


def boards_in(boards: DataFrame, spans: DataFrame, width: float = BUCKET_SECONDS) -> DataFrame:
    """Boards whose key frame lies in `[span_start, span_end)`. A merge: neither side passes through the driver, however small its file is."""
    left = boards.withColumn("_bucket", _bucket(F.col("key_ts"), width))
    right = _over_buckets(spans, "span_start", "span_end", width)
    return (
        left.hint("merge").join(right, ["lecture_id", "_bucket"])
        .where((F.col("key_ts") >= F.col("span_start")) & (F.col("key_ts") < F.col("span_end")))
        .drop("_bucket")
    )


def speech_around_board(
    boards: DataFrame, utterances: DataFrame, window: float = 45.0, max_words: int = 220, min_overlap: float = 0.3
) -> DataFrame:
    """`lecture_id, bid, context`: what was said around each board, cut to `max_words`."""
    spans = boards.select(
        "lecture_id", "bid",
        F.greatest(F.lit(0.0), F.col("start_s") - window).alias("span_start"),
        (F.col("end_s") + window * 0.25).alias("span_end"),
    )
    heard = utterances_in(utterances.select("lecture_id", "uid", "start_s", "end_s", "text"), spans, min_overlap)
    text = heard.groupBy("lecture_id", "bid").agg(joined_text(["uid"], strip(F.col("text")), " ").alias("context"))
    return (
        boards.select("lecture_id", "bid").join(text, ["lecture_id", "bid"], "left")
        .select("lecture_id", "bid", truncate_words(F.coalesce("context", F.lit("")), max_words).alias("context"))
    )


def segment_transcript(segments: DataFrame, utterances: DataFrame) -> DataFrame:
    """`lecture_id, sid, transcript`: texts of the listed utterances in list order; unknown ids skipped."""
    ids = segments.select("lecture_id", "sid", F.posexplode("utterance_ids").alias("pos", "uid"))
    said = ids.hint("merge").join(utterances.select("lecture_id", "uid", "text"), ["lecture_id", "uid"])
    return said.groupBy("lecture_id", "sid").agg(joined_text(["pos"], strip(F.col("text")), " ").alias("transcript"))


def full_text(utterances: DataFrame, part_rows: int | None = None) -> DataFrame:
    """`lecture_id, part, text`: all that was said, in order, as one text (`part` 0).

    With `part_rows`, parts of so many utterances, so that a huge recording is not forced into a single string.
    """
    rows = utterances.withColumn("part", F.lit(0).cast("long") if part_rows is None else block_of(F.col("uid"), part_rows))
    return rows.groupBy("lecture_id", "part").agg(joined_text(["uid"], strip(F.col("text")), " ").alias("text"))


def neighbour_chunks(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Chunks within `radius` places of a hit, as an equi-join on the numbers around it."""
    around = hits.select(
        *[c for c in hits.columns if c != "cid"], F.col("cid").alias("hit_cid"),
        F.explode(F.sequence(F.greatest(F.col("cid") - radius, F.lit(0)), F.col("cid") + radius)).alias("cid"),
    )
    return around.join(chunks, ["lecture_id", "cid"])


def match_marks(truth: DataFrame, predicted: DataFrame, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """One-to-one greedy matching: every true mark, in time order, takes the first free prediction within `tolerance`.

    Marks further apart than the tolerance cannot affect each other, so clusters of marks are dealt out apart, and each is
    one sorted pass that remembers the marks of two tolerances. Equal times are counted, not listed. Result: keys, n_true,
    n_pred, hits, precision, recall, f1.
    """
    keys = keys or ["lecture_id"]
    both = truth.select(*keys, F.col("t"), F.lit(1).alias("n_true"), F.lit(0).alias("n_pred")).unionByName(
        predicted.select(*keys, F.col("t"), F.lit(0).alias("n_true"), F.lit(1).alias("n_pred")))
    clusters = _clusters(both, keys, tolerance)
    ordered = clusters.repartition(*keys, "_cluster").sortWithinPartitions(*keys, "t").select(*keys, "t", "n_true", "n_pred")
    names = [*keys, "hits", "n_true", "n_pred"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*keys).schema)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count = None, [0, 0, 0]
        waiting, free = deque(), deque()

        def settle(now: float | None) -> None:
            """Match the true marks that nothing from `now` on can reach."""
            while waiting and (now is None or now - waiting[0][0] > tolerance):
                t, n = waiting.popleft()
                while n:
                    while free and t - free[0][0] > tolerance:
                        free.popleft()
                    if not free or free[0][0] - t > tolerance:
                        break
                    k = min(n, free[0][1])
                    count[0], n, free[0][1] = count[0] + k, n - k, free[0][1] - k
                    if not free[0][1]:
                        free.popleft()
            while free and not waiting and now is not None and now - free[0][0] > tolerance:
                free.popleft()

        for pdf in batches:
            done = []
            for *own, t, n_true, n_pred in pdf.itertuples(index=False, name=None):
                if own != key:
                    settle(None)
                    if key is not None:
                        done.append((*key, *count))
                    key, count[:] = own, [0, 0, 0]
                    free.clear()
                settle(t)
                if n_true:
                    waiting.append((t, n_true))
                if n_pred:
                    free.append([t, n_pred])
                count[1], count[2] = count[1] + n_true, count[2] + n_pred
            yield pd.DataFrame(done, columns=names)
        settle(None)
        if key is not None:
            yield pd.DataFrame([(*key, *count)], columns=names)

    counted = ordered.mapInPandas(fold, f"{kinds}, hits long, n_true long, n_pred long")
    per = counted.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("hits", "n_true", "n_pred")])
    return with_prf(per, "hits", "n_pred", "n_true")


def with_prf(df: DataFrame, hits: str, n_pred: str, n_true: str) -> DataFrame:
    """Adds precision, recall, f1; an empty side gives 0."""
    p = F.when(F.col(n_pred) > 0, F.col(hits) / F.col(n_pred)).otherwise(F.lit(0.0))
    r = F.when(F.col(n_true) > 0, F.col(hits) / F.col(n_true)).otherwise(F.lit(0.0))
    df = df.withColumns({"precision": p, "recall": r})
    total = F.col("precision") + F.col("recall")
    return df.withColumn(
        "f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def _clusters(marks: DataFrame, keys: list[str], tolerance: float, hour: float = 3600.0) -> DataFrame:
    """`_cluster`: the first time of the run of marks that are at most `tolerance` apart."""
    block = F.floor(F.col("t") / hour).cast("long")
    # stored: the running values read it four times
    rows = materialise(marks.groupBy(*keys, "t").agg(F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred")), "marks")
    seen = running(rows, keys, ["t"], block, {"_prev": ("prev", F.col("t"))})
    first = F.when(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > tolerance), F.col("t"))
    starts = running(seen, keys, ["t"], block, {"_cluster": ("last", first)})
    return starts.select(*keys, "t", "_cluster", "n_true", "n_pred")


def missed_marks(truth: DataFrame, predicted: DataFrame, tolerance: float) -> DataFrame:
    """True marks without any prediction within `tolerance`: an anti join on time buckets."""
    width = max(tolerance, 1.0)
    near = predicted.select(
        "lecture_id", F.col("t").alias("p"),
        F.explode(F.sequence(_bucket(F.col("t") - tolerance, width), _bucket(F.col("t") + tolerance, width))).alias("_bucket"))
    marks = truth.withColumn("_bucket", _bucket(F.col("t"), width))
    cond = (
        (marks["lecture_id"] == near["lecture_id"]) & (marks["_bucket"] == near["_bucket"])
        & (F.abs(near["p"] - marks["t"]) <= tolerance))
    return marks.join(near, cond, "left_anti").drop("_bucket")
