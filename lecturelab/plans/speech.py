"""Recogniser output of the sample users."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.functions.text import ends_sentence, looks_degenerate
from lecturelab.operators import asr as A
from lecturelab.params import AsrParams
from lecturelab.plans.oracle import rounded, sql
from lecturelab.plans.registry import query
from lecturelab.sources import tables as T

# segments of the sample users are hours apart
SLOW = AsrParams(group_pause=43_200.0, group_min_seconds=86_400.0, group_max_seconds=172_800.0)
END = r"""[.!?…][''\"»)\]]?\s*$"""

REASON = r"""select *, case when regexp_replace(text,'^\s+|\s+$','','g')='' then 'empty' when no_speech_prob>0.6 and avg_logprob < -1.0 then 'silence'
 when avg_logprob < -1.6 then 'low_confidence' when text like 'da da%' then 'repetition' end as reason from asr"""
FOLD = dict(
    reasons=REASON,
    kept="select *, row_number() over (partition by lecture_id order by seq) as k, regexp_matches(text,'[.!?…][''\"»)\\]]?\\s*$') as closes from reasons where reason is null",
    fold="""select lecture_id, k, seq, start_s, end_s, closes, start_s as g, seq as grp from kept where k=1
 union all select n.lecture_id, n.k, n.seq, n.start_s, n.end_s, n.closes,
 case when n.start_s-f.end_s>=43200 or n.end_s-f.g>=172800 or (f.closes and n.end_s-f.g>=86400) then n.start_s else f.g end,
 case when n.start_s-f.end_s>=43200 or n.end_s-f.g>=172800 or (f.closes and n.end_s-f.g>=86400) then n.seq else f.grp end
 from fold f join kept n on n.lecture_id=f.lecture_id and n.k=f.k+1""",
)


@query("looks_degenerate", sql("speech", r"""select lecture_id, uid, coalesce(total>=6 and top/total>=0.6,false) as degenerate from speech left join (
 select lecture_id, uid, sum(c) as total, max(c) as top from (select lecture_id, uid, w, count(*) as c from (
 select lecture_id, uid, unnest(regexp_extract_all(lower(text),'[\p{L}\p{N}_]+')) as w from speech) group by 1,2,3) group by 1,2) using (lecture_id, uid)"""))
def _degenerate(spark, sf):
    return T.speech(spark, sf).select("lecture_id", "uid", looks_degenerate(F.col("text")).alias("degenerate"))


@query("ends_sentence", sql("talks", f"select lecture_id, uid, regexp_matches(text,'{END}') as closes from talks"))
def _ends(spark, sf):
    return T.talks(spark, sf).select("lecture_id", "uid", ends_sentence(F.col("text")).alias("closes"))


@query("rejection_reason", sql("asr", "select lecture_id, seq, reason from reasons", reasons=REASON))
def _reason(spark, sf):
    return A.with_reason(T.asr_segments(spark, sf)).select("lecture_id", "seq", "reason")


@query("asr_drop_report", sql("asr", """select r.lecture_id, count(*) as raw, count(*) filter (reason is null) as kept, count(*) filter (reason is not null) as dropped,
 count(*) filter (reason='empty') as empty, count(*) filter (reason='silence') as silence, count(*) filter (reason='low_confidence') as low_confidence,
 count(*) filter (reason='repetition') as repetition,
 round_even(coalesce(sum(end_s-start_s) filter (reason is null),0)*1000/greatest(max(d.duration),1),0)/1000 as coverage
 from reasons r join (select lecture_id, count(*)*10.0::double as duration from asr group by 1) d using (lecture_id) group by 1""", reasons=REASON))
def _report(spark, sf):
    seg = T.asr_segments(spark, sf)
    lectures = seg.groupBy("lecture_id").agg((F.count(F.lit(1)) * 10.0).alias("duration"))
    return A.asr_drop_report(seg, lectures)


@query("pause_sessions", sql("asr", """select lecture_id, seq, cast(last_value(f ignore nulls) over (partition by lecture_id order by seq) as int) as session from (
 select lecture_id, seq, case when p is null or start_s-p>=43200 then seq end as f from (select *, lag(end_s) over (partition by lecture_id order by seq) as p from asr))"""))
def _sessions(spark, sf):
    return A.pause_sessions(T.asr_segments(spark, sf), SLOW.group_pause).select("lecture_id", "seq", "session")


@query("regroup_utterances", sql("asr", "select lecture_id, seq, grp from fold", recursive=True, **FOLD))
def _regroup(spark, sf):
    return A.regroup(A.kept_segments(T.asr_segments(spark, sf)), SLOW).select("lecture_id", "seq", "grp")


@query("utterance_rollup", sql("asr", r"""select lecture_id, cast(row_number() over (partition by lecture_id order by grp)-1 as int) as uid, round(s,6) as start_s, round(e,6) as end_s,
 text, round(lp,6) as avg_logprob, round(ns,6) as no_speech_prob from (
 select f.lecture_id, f.grp, arg_min(k.start_s,k.seq) as s, arg_max(k.end_s,k.seq) as e, string_agg(trim(k.text),' ' order by k.seq) as text,
 avg(k.avg_logprob) as lp, max(k.no_speech_prob) as ns from fold f join kept k using (lecture_id, seq) group by 1,2)""", recursive=True, **FOLD))
def _rollup(spark, sf):
    out = A.build_utterances(T.asr_segments(spark, sf), SLOW)
    return out.select("lecture_id", "uid", "text", *[rounded(c, 6).alias(c) for c in ("start_s", "end_s", "avg_logprob", "no_speech_prob")])
