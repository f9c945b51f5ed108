"""Prompt tables for a model that the caller brings, and the model call itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelab.functions.text import truncate_words
from lecturelab.functions.timecode import round_even, to_timecode
from lecturelab.operators.ordered import block_of, joined_text, running, top_n
from lecturelab.params import PromptParams
from lecturelab.session import materialise


def infer(prompts: DataFrame, fn: Callable[[str], str], keys: list[str], partitions: int | None = None) -> DataFrame:
    """`keys, result, error`: `fn(prompt)` per row. A failing row gets an error; if all fail, this raises.

    Results are written to the shared folder before the check, so no prompt is sent twice.
    `partitions` bounds the number of concurrent callers.
    """
    rows = prompts.select(*keys, "prompt")
    rows = rows.repartition(partitions) if partitions else rows
    schema = prompts.select(*keys).schema.add("result", "string").add("error", "string")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results, errors = [], []
            for prompt in pdf["prompt"]:
                try:
                    results.append(fn(prompt))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - one bad row must not end the batch
                    results.append(None)
                    errors.append(str(exc) or type(exc).__name__)
            out = pdf[keys].copy()
            out["result"], out["error"] = results, errors
            yield out

    done = materialise(rows.mapInPandas(call, schema), "infer")
    state = done.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.min("error").alias("first")).first()
    if state["n"] and state["n"] == state["bad"]:
        raise RuntimeError(f"all {state['n']} calls failed; one of the errors: {state['first']}")
    return done


def board_prompts(boards: DataFrame, context: DataFrame) -> DataFrame:
    """`lecture_id, bid, prompt`: time of the key frame and the speech around it; `context` from `speech_around_board`."""
    rows = boards.where(F.col("frame_path").isNotNull()).join(context, ["lecture_id", "bid"])
    said = F.when(F.col("context") != "", F.concat(F.lit("\nSpeech around the frame:\n"), F.col("context"))).otherwise("")
    return rows.select("lecture_id", "bid", F.concat(F.lit("Frame at "), to_timecode(F.col("key_ts")), said).alias("prompt"))


def earlier_titles(titles: DataFrame, wave_size: int = 4, keep: int = 8) -> DataFrame:
    """`lecture_id, sid, previous`: the last `keep` titles of successful sections in earlier waves, `; ` between.

    `titles`: lecture_id, sid (dense), title, ok. Each wave knows how many titles came before
    it; it then picks the few it shows by number, so nothing is collected per recording. The joins are merges, as in `section_prompts`.
    """
    rows = titles.withColumns({"wave": F.floor(F.col("sid") / wave_size), "_ok": F.col("ok").cast("long")})
    counted = running(rows, ["lecture_id"], ["sid"], block_of(F.col("sid")), {"_upto": ("sum", F.col("_ok"))})
    waves = counted.groupBy("lecture_id", "wave").agg(F.min(F.col("_upto") - F.col("_ok")).alias("_before"))
    numbered = counted.where("ok").select("lecture_id", "title", (F.col("_upto") - 1).alias("no"))
    wanted = waves.where("_before > 0").select(
        "lecture_id", "wave", F.explode(F.sequence(F.greatest(F.col("_before") - keep, F.lit(0)), F.col("_before") - 1)).alias("no"))
    shown = wanted.hint("merge").join(numbered, ["lecture_id", "no"]).groupBy("lecture_id", "wave").agg(joined_text(["no"], "title", "; ").alias("previous"))
    return rows.select("lecture_id", "sid", "wave").hint("merge").join(shown, ["lecture_id", "wave"], "left").select(
        "lecture_id", "sid", F.coalesce("previous", F.lit("")).alias("previous"))


def section_boards(segment_boards: DataFrame, limit: int = 6) -> DataFrame:
    """`lecture_id, sid, boards`: the first `limit` read boards of a segment as text blocks.

    `segment_boards`: lecture_id, sid, bid, key_ts, latex, caption, confidence. A confidence of 0 is not shown.
    """
    read = segment_boards.where(F.coalesce("latex", F.lit("")) != "")
    first = top_n(read, ["lecture_id", "sid"], [F.asc("bid")], limit, "pos")
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) != 0, F.concat(
        F.lit(" ("), round_even(F.col("confidence"), 2).cast("decimal(10,2)").cast("string"), F.lit(")"))).otherwise("")
    note = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("\n"), F.col("caption"))).otherwise("")
    block = F.concat(F.lit("### "), to_timecode(F.col("key_ts")), sure, F.lit("\n"), F.col("latex"), note)
    return first.groupBy("lecture_id", "sid").agg(joined_text(["pos"], block, "\n").alias("boards"))


def section_prompts(
    segments: DataFrame, transcripts: DataFrame, boards: DataFrame, previous: DataFrame, p: PromptParams = PromptParams()
) -> DataFrame:
    """Everything one section's prompt shows: index, total, time codes, transcript, boards, earlier titles.

    Each side has a row for each section or recording, so the joins are merges: Spark judges a stored table by its packed size and
    would send millions of its rows through the driver.
    """
    totals = segments.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("total"))
    out = segments.hint("merge").join(totals, "lecture_id")
    for df in (transcripts, boards, previous):
        out = out.hint("merge").join(df, ["lecture_id", "sid"], "left")
    return out.select(
        "lecture_id", "sid", (F.col("sid") + 1).alias("index"), "total",
        to_timecode(F.col("start_s")).alias("start_tc"), to_timecode(F.col("end_s")).alias("end_tc"),
        truncate_words(F.coalesce("transcript", F.lit("")), p.max_transcript_words).alias("transcript"),
        F.coalesce("boards", F.lit("")).alias("boards"), F.coalesce("previous", F.lit("")).alias("previous"))


def context_block(tc, title, text, board):
    extra = F.when(F.coalesce(board, F.lit("")) != "", F.concat(F.lit("\nBoard:\n"), board)).otherwise("")
    return F.concat(F.lit("### ["), tc, F.lit("] "), title, F.lit("\n"), text, extra)


def qa_prompts(context: DataFrame, questions: DataFrame) -> DataFrame:
    """`lecture_id, query_id, prompt`: the context passages in order, then the question."""
    block = context_block(to_timecode(F.col("start_s")), F.col("title"), F.col("text"), F.col("board"))
    per = context.groupBy("lecture_id", "query_id").agg(joined_text(["pos"], block, "\n\n").alias("passages"))
    return questions.join(per, ["lecture_id", "query_id"]).select(
        "lecture_id", "query_id", F.concat(F.col("passages"), F.lit("\n\n## Question\n"), F.col("question")).alias("prompt"))


def quiz_groups(chunks: DataFrame, n_questions: int = 10, size: int = 4, max_words: int = 400) -> DataFrame:
    """`lecture_id, grp, per_group, chunks, material`: fixed groups of chunks and how many questions each gets."""
    counts = chunks.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = F.ceil(F.col("_n") / size)
    per_group = F.greatest(F.lit(1), F.rint(F.lit(n_questions) / groups).cast("int"))
    block = context_block(to_timecode(F.col("start_s")), F.col("title"), truncate_words(F.col("text"), max_words), F.col("board"))
    per = chunks.groupBy("lecture_id", F.floor(F.col("cid") / size).cast("int").alias("grp")).agg(
        F.count(F.lit(1)).alias("chunks"), joined_text(["cid"], block, "\n\n").alias("material"))
    return per.join(counts, "lecture_id").select("lecture_id", "grp", per_group.alias("per_group"), "chunks", "material")


def summary_inputs(segments: DataFrame, transcripts: DataFrame, max_words: int = 12_000) -> DataFrame:
    """`lecture_id, sid, tc, title, body`: note or, without one, transcript, cut to the section's share of words."""
    totals = segments.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = segments.join(totals, "lecture_id").join(transcripts, ["lecture_id", "sid"], "left")
    budget = F.greatest(F.lit(200), F.floor(F.lit(max_words) / F.greatest(F.col("_n"), F.lit(1))).cast("int"))
    text = F.when(F.trim(F.coalesce("body", F.lit(""))) != "", F.col("body")).otherwise(F.coalesce("transcript", F.lit("")))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.lit("Раздел"))
    return rows.select(
        "lecture_id", "sid", to_timecode(F.col("start_s")).alias("tc"), title.alias("title"), truncate_words(text, budget).alias("body"))


def summary_misses(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests whose `key` has no stored summary yet; each key once."""
    return requests.join(stored.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])
