"""Quality filter for recognised segments and their regrouping into utterances."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lecturelab.functions.text import ends_sentence, looks_degenerate, squeeze, strip
from lecturelab.functions.timecode import round_even
from lecturelab.operators.ordered import BLOCK_ROWS, block_of, dense_index, joined_text, running
from lecturelab.params import AsrParams
from lecturelab.session import materialise


def rejection_reason(text: Column, no_speech: Column, logprob: Column, p: AsrParams = AsrParams()) -> Column:
    """`empty`, `silence`, `low_confidence`, `repetition`, or null for a good segment. A null measure never rejects."""
    silent = (no_speech > p.max_no_speech) & (logprob < p.min_avg_logprob)
    return (
        F.when(strip(text) == "", F.lit("empty"))
        .when(silent, F.lit("silence"))
        .when(logprob < p.hard_min_logprob, F.lit("low_confidence"))
        .when(looks_degenerate(text), F.lit("repetition"))
    )


def with_reason(segments: DataFrame, p: AsrParams = AsrParams()) -> DataFrame:
    return segments.withColumn(
        "reason", rejection_reason(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"), p))


def kept_segments(segments: DataFrame, p: AsrParams = AsrParams()) -> DataFrame:
    return with_reason(segments, p).where(F.col("reason").isNull()).drop("reason")


REASONS = ("empty", "silence", "low_confidence", "repetition")


def asr_drop_report(segments: DataFrame, lectures: DataFrame, p: AsrParams = AsrParams()) -> DataFrame:
    """Per recording: raw, kept, dropped, dropped by reason, share of the duration that was kept."""
    judged = with_reason(segments, p)
    kept = F.col("reason").isNull()
    per = judged.groupBy("lecture_id").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(kept).alias("kept"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS],
        F.sum(F.when(kept, F.col("end_s") - F.col("start_s")).otherwise(0.0)).alias("_seconds"),
    )
    joined = per.join(lectures.select("lecture_id", "duration"), "lecture_id", "left")
    coverage = round_even(F.col("_seconds") / F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(1.0)), 3)
    return joined.select(
        "lecture_id", "raw", "kept", (F.col("raw") - F.col("kept")).alias("dropped"), *REASONS, coverage.alias("coverage"))


def pause_sessions(segments: DataFrame, pause: float = 1.2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `session`: the `seq` at which the run of segments without a pause of `pause` seconds began."""
    block = block_of(F.col("seq"), block_rows)
    seen = running(segments, ["lecture_id"], ["seq"], block, {"_prev_end": ("prev", F.col("end_s"))})
    # the same subtraction as the rule states, so equality at the limit is a break
    first = F.when(F.col("_prev_end").isNull() | (F.col("start_s") - F.col("_prev_end") >= pause), F.col("seq"))
    return running(seen, ["lecture_id"], ["seq"], block, {"session": ("last", first)}).drop("_prev_end")


#: What one block of a recording does to the utterance group that is open when it begins (see `_block_table`).
BLOCK_TABLE = (
    "lecture_id string, block bigint, first_seq int, first_start double, first_end double, last_end double, last_closes boolean, "
    "first_grp int, first_at double, kinds array<int>, ends array<double>, grps array<int>, ats array<double>")
ENTRY = "lecture_id string, block bigint, opens boolean, open_grp int, open_at double"
PAUSE, LONG, CLOSED = 0, 1, 2


def regroup(segments: DataFrame, p: AsrParams = AsrParams(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `grp`: the `seq` of the segment that opens the utterance group.

    A segment opens a group after a long pause, or when the open group, this segment included, would be too long, or long
    enough and the segment before ended a sentence. So all that a row asks of the past is when the open group began.
    A recording, even one without any pause, is cut into blocks of its order, and three passes give what one pass
    from its start would:

    1. each block by itself: for any begin of the open group, at which row it ends and which group is open at the
       end of the block. Groups that end at the same row are one from there on, so few are followed at a time;
    2. the blocks of a recording in order, one row each: the group that is open where each begins;
    3. each block by itself, from that group.

    The numbers the passes need are stored once, so the segments are read once here. A null or missing end before a row is a pause.
    """
    limits = p.group_pause, p.group_min_seconds, p.group_max_seconds
    block = block_of(F.col("seq"), block_rows)
    slim = materialise(segments.select(
        "lecture_id", block.alias("block"), "seq", "start_s", "end_s", ends_sentence(F.col("text")).alias("closes")), "regroup")
    # the latest begin a group that comes into a block can have; without it a block would have to answer for any begin
    spans = slim.groupBy("lecture_id", "block").agg(F.max(F.coalesce("start_s", F.lit(float("inf")))).alias("latest"))
    before = Window.partitionBy("lecture_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.select("lecture_id", "block", F.coalesce(F.max("latest").over(before), F.lit(float("-inf"))).alias("reach"))
    spread = slim.repartition("lecture_id", "block")
    tables = spread.join(reach, ["lecture_id", "block"]).sortWithinPartitions("lecture_id", "block", "seq").mapInPandas(
        lambda batches: _block_tables(batches, *limits), BLOCK_TABLE)
    entries = tables.repartition("lecture_id").sortWithinPartitions("lecture_id", "block").mapInPandas(
        lambda batches: _entries(batches, *limits), ENTRY)
    groups = spread.join(entries, ["lecture_id", "block"]).sortWithinPartitions("lecture_id", "block", "seq").mapInPandas(
        lambda batches: _groups(batches, *limits), "lecture_id string, seq int, grp int")
    return segments.join(groups, ["lecture_id", "seq"])


def _rows(pdf: pd.DataFrame, *names: str) -> Iterator[tuple]:
    return zip(*[pdf[name].tolist() for name in names])


def _block_tables(batches: Iterator[pd.DataFrame], pause: float, shortest: float, longest: float) -> Iterator[pd.DataFrame]:
    """One row per block: its ends, the group open at its end if the first row opens one (`first_grp`, `first_at`), and
    answers for a group that goes on past the first row: the first whose condition its begin meets names the group
    that is open at the end instead. Answers stop where no group that can come in goes on."""
    at, done = None, []
    for pdf in batches:
        for lecture, block, seq, start, end, closes, reach in _rows(pdf, "lecture_id", "block", "seq", "start_s", "end_s", "closes", "reach"):
            if at != (lecture, block):
                if at is not None:
                    done.append(_finished(at, head, answers, live, last_end, last_closes))
                at, head, answers = (lecture, block), (seq, start, end), []
                #: begins followed: [begin, opening seq, the answers that lead to it]; -1 stands for the first row
                live = [[start, seq, [-1]]]
                far_end, far_closed, sealed = end, float("-inf"), end - reach >= longest
            else:
                paused = last_end != last_end or start - last_end >= pause
                ended, going = [], []
                for g in live:
                    (ended if paused or end - g[0] >= longest or (last_closes and end - g[0] >= shortest) else going).append(g)
                new = []
                if not sealed:
                    if paused:
                        new.append((PAUSE, end))
                    else:
                        if not end <= far_end:
                            new.append((LONG, end))
                        if last_closes and not end <= far_closed:
                            new.append((CLOSED, end))
                    sealed = paused or end - reach >= longest
                    far_end = end if not end <= far_end else far_end
                    far_closed = end if last_closes and not end <= far_closed else far_closed
                if ended or new:
                    led = [a for g in ended for a in g[2]] + list(range(len(answers), len(answers) + len(new)))
                    live = [*going, [start, seq, led]]
                    answers += new
            last_end, last_closes = end, bool(closes)
        if len(done) >= 256:
            yield pd.DataFrame(done, columns=TABLE_COLUMNS)
            done = []
    if at is not None:
        done.append(_finished(at, head, answers, live, last_end, last_closes))
    yield pd.DataFrame(done, columns=TABLE_COLUMNS)


TABLE_COLUMNS = [field.split()[0] for field in BLOCK_TABLE.split(", ")]


def _finished(at: tuple, head: tuple, answers: list, live: list, last_end: float, last_closes: bool) -> tuple:
    exits = {a: (opened, begin) for begin, opened, led in live for a in led}
    leads = [exits[i] for i in range(len(answers))]
    return (*at, *head, last_end, last_closes, *exits[-1], [kind for kind, _ in answers], [end for _, end in answers],
            [opened for opened, _ in leads], [begin for _, begin in leads])


def _entries(batches: Iterator[pd.DataFrame], pause: float, shortest: float, longest: float) -> Iterator[pd.DataFrame]:
    """Per block, in order: whether its first row opens a group, and else the group that goes on."""
    key = None
    for pdf in batches:
        out = []
        for (lecture, block, seq, start, end, last_end, last_closes, first_grp, first_at, kinds, ends, grps, ats) in _rows(pdf, *TABLE_COLUMNS):
            opens = key != lecture
            if not opens:
                length = end - begun
                opens = before != before or start - before >= pause or length >= longest or (closed and length >= shortest)
            out.append((lecture, block, opens, seq if opens else opened, start if opens else begun))
            if opens:
                opened, begun = first_grp, first_at
            else:
                for kind, far, grp, begin in zip(kinds, ends, grps, ats):
                    if kind == PAUSE or far - begun >= (longest if kind == LONG else shortest):
                        opened, begun = grp, begin
                        break
            key, before, closed = lecture, last_end, last_closes
        yield pd.DataFrame(out, columns=["lecture_id", "block", "opens", "open_grp", "open_at"])


def _groups(batches: Iterator[pd.DataFrame], pause: float, shortest: float, longest: float) -> Iterator[pd.DataFrame]:
    at = None
    for pdf in batches:
        grp = []
        for lecture, block, seq, start, end, closes, open_grp, open_at in _rows(
            pdf, "lecture_id", "block", "seq", "start_s", "end_s", "closes", "open_grp", "open_at"
        ):
            if at != (lecture, block):  # the entry has judged the first row
                at, opened, begun = (lecture, block), open_grp, open_at
            else:
                length = end - begun
                if last_end != last_end or start - last_end >= pause or length >= longest or (closed and length >= shortest):
                    opened, begun = seq, start
            last_end, closed = end, closes
            grp.append(opened)
        yield pd.DataFrame({"lecture_id": pdf["lecture_id"], "seq": pdf["seq"], "grp": grp})


def utterance_rollup(grouped: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One utterance per group: `lecture_id, uid, start_s, end_s, text, avg_logprob, no_speech_prob`."""
    per = grouped.groupBy("lecture_id", "grp").agg(
        F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"),
        joined_text(["seq"], strip(F.col("text")), " ").alias("_text"),
        F.avg("avg_logprob").alias("avg_logprob"), F.max("no_speech_prob").alias("no_speech_prob"),
    ).withColumn("text", squeeze(F.col("_text")))
    numbered = dense_index(per, ["lecture_id"], ["grp"], block_of(F.col("grp"), block_rows), "uid")
    return numbered.select("lecture_id", "uid", "start_s", "end_s", "text", "avg_logprob", "no_speech_prob")


def build_utterances(segments: DataFrame, p: AsrParams = AsrParams()) -> DataFrame:
    """Raw segments to utterances: filter, regroup, roll up."""
    return utterance_rollup(regroup(kept_segments(segments, p), p))
