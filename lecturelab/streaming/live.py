"""The same rules on streams. State per key is a few numbers and the rows of the lateness; later rows fall to the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lecturelab.functions.text import ends_sentence
from lecturelab.operators.asr import with_reason
from lecturelab.operators.cost import stage_events, usage_cost
from lecturelab.params import AsrParams, BoardParams
from lecturelab.session import scratch_path


def stream_asr_filter(segments: DataFrame, p: AsrParams = AsrParams()) -> DataFrame:
    """Kept segments of a stream; the rule looks at one row."""
    return with_reason(segments, p).where(F.col("reason").isNull()).drop("reason")


def stream_pause_sessions(segments: DataFrame, pause: float, lateness: str = "1 hour") -> DataFrame:
    """Runs of segments without a pause: `lecture_id, start_s, end_s, segments`; `segments` has a timestamp `ts` of its start.

    A session window merges rows whose distance equals the gap while the rule breaks there,
    hence one microsecond less.
    """
    lasting = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    micros = F.rint((lasting + pause) * 1e6).cast("long") - 1
    gap = F.concat(micros.cast("string"), F.lit(" microseconds"))
    marked = segments.withWatermark("ts", lateness)
    return marked.groupBy("lecture_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("segments")).drop("w")


REGROUP_OUT = "lecture_id string, grp int, start_s double, end_s double, segments int"
OPEN_GROUP = "grp int, opened double, last double, last_ms bigint, closes boolean, segments int"
WAITING = "seqs array<int>, starts array<double>, ends array<double>, closings array<boolean>, stamps array<bigint>"
BUCKET_MS = 60_000
CHUNK_ROWS = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_minute(row: tuple) -> tuple[int, tuple]:
    return row[4] // BUCKET_MS, row


class RegroupProcessor(StatefulProcessor):
    """One recording: the open group in a few numbers, and the rows that wait for the watermark in chunks.

    A trigger adds its rows as new chunks in the order of time, whose keys tell the first and the last minute. Rows are due by
    minutes: a chunk is read when the watermark has passed its first minute, and what is not due is put back as a chunk. So
    a trigger costs its new rows and the chunks it folds, and a few calls of the state for each chunk, not for each row.
    """

    def __init__(self, p: AsrParams) -> None:
        self.pause, self.shortest, self.longest = p.group_pause, p.group_min_seconds, p.group_max_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", OPEN_GROUP)
        self.waiting = handle.getMapState("waiting", "opens bigint, ends bigint, seq int", WAITING)

    def close(self) -> None:
        pass

    def _wait(self, rows: list[tuple]) -> None:
        """Keep `rows`, sorted by minute, as one chunk, and wake up when its first minute is over."""
        opens, ends = rows[0][4] // BUCKET_MS, rows[-1][4] // BUCKET_MS
        key = (opens, ends, rows[0][0])
        if self.waiting.containsKey(key):  # the first row came twice
            rows = sorted([*zip(*self.waiting.getValue(key)), *rows], key=_by_minute)
        self.waiting.updateValue(key, tuple(list(column) for column in zip(*rows)))
        self.handle.registerTimer((opens + 1) * BUCKET_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come: list[tuple] = []
        for pdf in rows:
            stamps = pdf["ts"].astype("datetime64[us]").astype("int64") // 1_000
            come += zip(*(c.tolist() for c in (pdf["seq"], pdf["start_s"], pdf["end_s"], pdf["closes"], stamps)))
        come.sort(key=_by_minute)
        for at in range(0, len(come), CHUNK_ROWS):
            self._wait(come[at: at + CHUNK_ROWS])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark, not this timer's time: a timer set now for a time that is past would wait for another trigger
        until, out = timerValues.getCurrentWatermarkInMs(), []
        grp, opened, last, last_ms, closed, n = self.group.get() if self.group.exists() else (-1, 0.0, 0.0, 0, False, 0)
        chunks = list(self.waiting.keys())
        reached = [k for k in chunks if (k[0] + 1) * BUCKET_MS <= until]
        left, due = len(chunks) - len(reached), []
        for k in reached:
            rows = [*zip(*self.waiting.getValue(k))]
            self.waiting.removeKey(k)
            if (k[1] + 1) * BUCKET_MS <= until:
                due += rows
            else:
                due += (r for r in rows if (r[4] // BUCKET_MS + 1) * BUCKET_MS <= until)
                self._wait([r for r in rows if (r[4] // BUCKET_MS + 1) * BUCKET_MS > until])
                left += 1
        for seq, start, end, closes, stamp in sorted(due, key=_by_minute):
            length = end - opened
            if grp >= 0 and (start - last >= self.pause or length >= self.longest or (closed and length >= self.shortest)):
                out.append((key[0], grp, opened, last, n))
                grp = -1
            if grp < 0:
                grp, opened, n = seq, start, 0
            last, closed, n = end, closes, n + 1
            last_ms = stamp + int((end - start) * 1000) + 1
        over = last_ms + int(self.pause * 1000) + 1
        if grp >= 0 and not left:
            if until >= over:  # whatever still comes opens the next group
                out.append((key[0], grp, opened, last, n))
                grp = -1
            else:
                self.handle.registerTimer(over)
        if grp < 0:
            self.group.clear()
        else:
            self.group.update((int(grp), float(opened), float(last), int(last_ms), bool(closed), int(n)))
        if out:
            yield pd.DataFrame(out, columns=["lecture_id", "grp", "start_s", "end_s", "segments"])


def stream_regroup(segments: DataFrame, p: AsrParams = AsrParams(), lateness: str = "1 hour") -> DataFrame:
    """Utterance groups of a stream of kept segments.

    Rows inside the watermark may arrive out of order: they wait in state, in chunks, until the watermark has passed their
    minute and are then folded in order. A group is emitted when the next one opens, or once the watermark is so far past
    its last row that whatever still comes must open the next one; timers wake the key for both, without another row.
    Rows later than the watermark are dropped and counted (`late_rows`). Sets the session's state store to RocksDB, which
    keyed state of this kind needs.
    """
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = segments.select(
        "lecture_id", "seq", "start_s", "end_s", ends_sentence(F.col("text")).alias("closes"), "ts").withWatermark("ts", lateness)
    return marked.groupBy("lecture_id").transformWithStateInPandas(
        statefulProcessor=RegroupProcessor(p), outputStructType=REGROUP_OUT, outputMode="append", timeMode="eventTime")


def stream_usage(usage: DataFrame, rates: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Cost per recording and tumbling window; the price list is a static side."""
    priced = usage_cost(usage.withWatermark("ts", lateness), rates)
    return priced.groupBy("lecture_id", F.window("ts", width).alias("w")).agg(
        F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd")).select("lecture_id", F.col("w.start").alias("hour"), "calls", "input_tokens", "output_tokens", "cost_usd")


def stream_stage_status(lines: DataFrame) -> DataFrame:
    """Latest state of each stage of each run (update mode)."""
    return stage_events(lines).groupBy("run", "stage").agg(
        F.max_by("state", "line_no").alias("state"), F.max("line_no").alias("line_no"))


def stream_board_cuts(masks: DataFrame, p: BoardParams = BoardParams(), lateness: str = "1 hour", apart: str = "1 hour") -> DataFrame:
    """`lecture_id, frame_idx` where a new board state opens, from bit-packed masks (`ts`: seconds, `frame_idx`: dense).

    A frame meets the one before it in a join of the stream with itself on `(lecture_id, frame_idx)`, so frames may come in
    any order, over any number of triggers, as long as none is later than `lateness`; a long recording is spread
    over all tasks. Both sides are forgotten once the watermark is past whatever they could still meet: the state holds
    the frames of `lateness` and `apart` together, however long the recording. Frames more than `apart` after the one
    before are not compared with it.
    """
    # a day on: the first watermark is the epoch, and a frame at second 0 would be late for it
    at = F.timestamp_micros(F.rint((F.col("ts") + 86_400) * 1e6).cast("long"))
    stamped = masks.select("lecture_id", "frame_idx", "n_px", "words", at.alias("at"))
    now = stamped.withWatermark("at", lateness)
    earlier = stamped.select(
        F.col("lecture_id").alias("_lecture"), (F.col("frame_idx") + 1).alias("_next"), F.col("words").alias("before"), F.col("at").alias("_at")).withWatermark("_at", lateness)
    in_time = F.expr(f"at >= _at and at <= _at + interval {apart}")
    pairs = now.join(earlier, (F.col("lecture_id") == F.col("_lecture")) & (F.col("frame_idx") == F.col("_next")) & in_time)
    gone = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
    removed, added = gone("before", "words") / F.col("n_px"), gone("words", "before") / F.col("n_px")
    return pairs.where((removed > p.tau_erase) | (added > p.tau_jump)).select("lecture_id", "frame_idx")


def late_rows(progress: list) -> int:
    """Rows that the watermark had passed when they came, over all triggers in `progress`."""
    return sum(op["numRowsDroppedByWatermark"] for trigger in progress for op in trigger["stateOperators"])


def state_rows(progress: list) -> int:
    """The most rows that were held at the end of a trigger."""
    return max((sum(op["numRowsTotal"] for op in trigger["stateOperators"]) for trigger in progress), default=0)


def run_available(stream: DataFrame, label: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run the stream over everything there is, and return what it wrote; `progress` gets the reports of its triggers.

    Files in the shared folder for append mode. In update mode every batch is written as it
    comes and the reader keeps the newest row per key.
    """
    spark = stream.sparkSession
    out, mark = scratch_path(spark, label), scratch_path(spark, f"{label}-offsets")
    writer = stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(out)
