"""Streams over the sample files, run until everything available is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.operators.asr import kept_segments
from lecturelab.plans.cost import LOG, RATES, log_lines
from lecturelab.plans.oracle import rounded, sql
from lecturelab.plans.registry import query
from lecturelab.plans.speech import FOLD, REASON, SLOW
from lecturelab.session import scratch_path
from lecturelab.sources import prices
from lecturelab.sources import tables as T
from lecturelab.streaming import live


def _replayed(df, label):
    """A batch table as a stream of files in the shared folder."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"{label}-in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _stamped(spark, sf):
    rows = T.asr_segments(spark, sf)
    return rows.withColumn("ts", F.timestamp_micros(F.rint(F.col("start_s") * 1e6).cast("long")))


@query("stream_asr_filter", sql("asr", "select lecture_id, seq, text from reasons where reason is null", reasons=REASON))
def _filter(spark, sf):
    kept = live.stream_asr_filter(_replayed(T.asr_segments(spark, sf), "asr"))
    return live.run_available(kept, "asr-kept").select("lecture_id", "seq", "text")


@query("stream_stage_status", sql("", "select run, stage, state from status", **LOG))
def _status(spark, sf):
    stream = live.stream_stage_status(_replayed(log_lines(spark, sf), "log"))
    seen = live.run_available(stream, "status", "update")
    return seen.groupBy("run", "stage").agg(F.max_by("state", "line_no").alias("state"))


@query("stream_usage", sql("usage rates billed priced", """select lecture_id, strftime(date_trunc('hour', ts),'%Y-%m-%d %H') as hour, cast(sum(calls) as bigint) as calls, cast(sum(input_tokens) as bigint) as input_tokens, round(sum(cost_usd),6) as cost_usd
 from priced group by 1,2"""))
def _usage(spark, sf):
    use = T.usage(spark, sf)
    use = use.withColumns({"model": F.when(F.col("model") == "", "m-large").otherwise(F.col("model")), "ts": F.expr("cast(ts as timestamp)")})
    out = live.run_available(live.stream_usage(_replayed(use, "usage"), prices.model_rates(spark, RATES)), "usage-hours", "update")
    # the newest row of a window is the one with the most calls
    last = out.groupBy("lecture_id", "hour").agg(F.max_by(F.struct("calls", "input_tokens", "cost_usd"), "calls").alias("r"))
    return last.select("lecture_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "r.calls", "r.input_tokens", rounded("r.cost_usd", 6).alias("cost_usd"))


def _ended(df):
    """With one row far in the future under an empty id, so that the watermark passes all others."""
    known = {"lecture_id": F.lit(""), "ts": F.lit("2100-01-01 00:00:00").cast("timestamp")}
    last = df.sparkSession.range(1).select(*[known.get(f.name, F.lit("0").cast(f.dataType)).alias(f.name) for f in df.schema])
    return df.unionByName(last)


@query("stream_pause_sessions", sql("asr", """select lecture_id, round(min(start_s),6) as start_s, round(max(end_s),6) as end_s, count(*) as segments from (
 select *, sum(case when p is null or start_s-p>=43200 then 1 else 0 end) over (partition by lecture_id order by start_s, seq) as g from (
 select *, max(greatest(start_s,end_s)) over (partition by lecture_id order by start_s, seq rows between unbounded preceding and 1 preceding) as p from asr)) group by lecture_id, g"""))
def _sessions(spark, sf):
    stream = live.stream_pause_sessions(_replayed(_ended(_stamped(spark, sf)), "segments"), 43_200.0)
    out = live.run_available(stream, "sessions").where("lecture_id <> ''")
    return out.select("lecture_id", rounded("start_s", 6).alias("start_s"), rounded("end_s", 6).alias("end_s"), "segments")


@query("stream_regroup", sql("asr", """select lecture_id, grp, round(arg_min(k.start_s,k.seq),6) as start_s, round(arg_max(k.end_s,k.seq),6) as end_s, count(*) as segments
 from fold f join kept k using (lecture_id, seq) group by 1,2""", recursive=True, **FOLD))
def _regroup(spark, sf):
    kept = kept_segments(_stamped(spark, sf))
    out = live.run_available(live.stream_regroup(_replayed(_ended(kept), "kept"), SLOW), "groups").where("lecture_id <> ''")
    return out.select("lecture_id", "grp", rounded("start_s", 6).alias("start_s"), rounded("end_s", 6).alias("end_s"), "segments")


@query("stream_board_cuts", sql("frames px", "select lecture_id, frame_idx from delta where removed>0.30 or added>0.30",
    both_="""select lecture_id, frame_idx, y, x, max(c) as cur, max(o) as old from (select lecture_id, frame_idx, y, x, 1 as c, 0 as o from px
 union all select lecture_id, frame_idx+1, y, x, 0, 1 from px) group by 1,2,3,4""",
    delta="""select f.lecture_id, f.frame_idx, coalesce(sum(case when old=0 then 1 else 0 end),0)/64 as added, coalesce(sum(case when cur=0 then 1 else 0 end),0)/64 as removed
 from frames f left join both_ using (lecture_id, frame_idx) where f.frame_idx>0 group by 1,2"""))
def _cuts(spark, sf):
    from lecturelab.params import BoardParams
    masks = T.masks(spark, sf).select("lecture_id", "frame_idx", "n_px", "words", "ts")
    return live.run_available(live.stream_board_cuts(_replayed(masks, "masks"), BoardParams(tau_erase=0.30, tau_jump=0.30)), "cuts")
