"""Spans and interval joins over the sample recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.functions.spans import span_iou, span_is_valid, span_overlap
from lecturelab.operators import intervals as J
from lecturelab.plans.oracle import cut, rounded, sql
from lecturelab.plans.registry import query
from lecturelab.plans.retrieval import segments_with_boards
from lecturelab.sources import tables as T


@query("span_validate", sql("asr", """select lecture_id, cast(sum(case when ok then 1 else 0 end) as bigint) as valid,
 cast(sum(case when ok then 0 else 1 end) as bigint) as rejected from (select lecture_id, start_s>=0 and e>=0 and e>=start_s as ok
 from (select lecture_id, start_s, end_s-20 as e from asr)) group by 1"""))
def _validate(spark, sf):
    spans = T.asr_segments(spark, sf).select("lecture_id", "start_s", (F.col("end_s") - 20).alias("end_s"))
    ok = span_is_valid(F.col("start_s"), F.col("end_s"))
    return spans.groupBy("lecture_id").agg(
        F.sum(F.when(ok, 1).otherwise(0)).alias("valid"), F.sum(F.when(ok, 0).otherwise(1)).alias("rejected"))


NEXT = """select lecture_id, uid, start_s, end_s+1.5 as end_s, lead(start_s) over w as s2, lead(end_s) over w as e2 from speech window w as (partition by lecture_id order by uid)"""


@query("span_overlap", sql("speech", """select lecture_id, uid, round(ov,6) as overlap, round(case when u>0 then ov/u else 0 end,6) as iou from
 (select *, (end_s-start_s)+(e2-s2)-ov as u from (select *, greatest(0, least(end_s,e2)-greatest(start_s,s2)) as ov from nxt where s2 is not null))""", nxt=NEXT))
def _overlap(spark, sf):
    from lecturelab.operators.ordered import shifted
    rows = shifted(T.speech(spark, sf).select("lecture_id", "uid", "start_s", "end_s"), ["lecture_id"], "uid",
                   {"s2": ("start_s", 1), "e2": ("end_s", 1)}).where("s2 is not null")
    args = (F.col("start_s"), F.col("end_s") + 1.5, F.col("s2"), F.col("e2"))
    return rows.select("lecture_id", "uid", rounded(span_overlap(*args), 6).alias("overlap"), rounded(span_iou(*args), 6).alias("iou"))


@query("merge_spans", sql("speech", "select lecture_id, round(min(start_s),6) as start_s, round(max(end_s),6) as end_s from speech group by 1"))
def _merge(spark, sf):
    return J.merge_spans(T.speech(spark, sf), ["lecture_id"]).select(
        "lecture_id", rounded("start_s", 6).alias("start_s"), rounded("end_s", 6).alias("end_s"))


@query("utterances_in", sql("speech boards", """select u.lecture_id, b.bid, u.uid from speech u join boards b on u.lecture_id=b.lecture_id
 where u.end_s>u.start_s and greatest(0, least(u.end_s,b.end_s)-greatest(u.start_s,b.start_s))/(u.end_s-u.start_s)>=0.5"""))
def _utterances_in(spark, sf):
    spans = T.boards(spark, sf).select("lecture_id", "bid", F.col("start_s").alias("span_start"), F.col("end_s").alias("span_end"))
    return J.utterances_in(T.speech(spark, sf, with_boards=True).drop("text"), spans).select("lecture_id", "bid", "uid")


@query("boards_in", sql("segments boards", """select s.lecture_id, s.sid, b.bid from segments s join boards b on s.lecture_id=b.lecture_id
 where b.key_ts>=s.start_s and b.key_ts<s.end_s"""))
def _boards_in(spark, sf):
    spans = T.segments(spark, sf).select("lecture_id", "sid", F.col("start_s").alias("span_start"), F.col("end_s").alias("span_end"))
    return J.boards_in(T.boards(spark, sf), spans).select("lecture_id", "sid", "bid")


AROUND = """select b.lecture_id, b.bid, coalesce(string_agg(u.text,' ' order by u.uid),'') as said from boards b left join speech u
 on u.lecture_id=b.lecture_id and u.end_s>u.start_s
 and greatest(0, least(u.end_s,b.end_s+11.25)-greatest(u.start_s,greatest(0,b.start_s-45)))/(u.end_s-u.start_s)>=0.3 group by 1,2"""


@query("speech_around_board", sql("speech boards", f"select lecture_id, bid, {cut('said', 220)} as context from around", around=AROUND))
def _around(spark, sf):
    return J.speech_around_board(T.boards(spark, sf), T.speech(spark, sf, with_boards=True))


@query("segment_transcript", sql("speech", "select lecture_id, uid//12 as sid, string_agg(text,' ' order by uid) as transcript from speech group by 1,2"))
def _transcript(spark, sf):
    return J.segment_transcript(T.segments(spark, sf), T.speech(spark, sf))


@query("full_text", sql("speech", "select lecture_id, 0 as part, md5(string_agg(text,' ' order by uid)) as text_md5 from speech group by 1"))
def _full(spark, sf):
    return J.full_text(T.speech(spark, sf)).select("lecture_id", "part", F.md5("text").alias("text_md5"))


def marks(spark, sf):
    truth = T.boards(spark, sf).select("lecture_id", F.col("start_s").alias("t"))
    pred = T.segments(spark, sf).select("lecture_id", F.col("start_s").alias("t"))
    return truth, pred


MATCH = dict(
    tru="select lecture_id, start_s as t, row_number() over (partition by lecture_id order by start_s) as i from boards",
    prd="select lecture_id, start_s as p, row_number() over (partition by lecture_id order by start_s) as j from segments",
    allp="select lecture_id, list(p order by p) as ps from prd group by 1",
    walk="""select t.lecture_id, 0::bigint as i, []::bigint[] as used from tru t where i=1
 union all select w.lecture_id, t.i, case when x.j is null then w.used else list_append(w.used, x.j) end from walk w join tru t on t.lecture_id=w.lecture_id and t.i=w.i+1
 left join lateral (select min(p.j) as j from prd p where p.lecture_id=w.lecture_id and abs(p.p-t.t)<=10 and not list_contains(w.used,p.j)) x on true""",
    hits="select lecture_id, max(len(used)) as hits from walk group by 1",
    sides="""select coalesce(a.lecture_id,b.lecture_id) as lecture_id, coalesce(a.n,0) as n_true, coalesce(b.n,0) as n_pred from
 (select lecture_id, count(*) as n from tru group by 1) a full join (select lecture_id, count(*) as n from prd group by 1) b on a.lecture_id=b.lecture_id""",
    prf="""select s.*, coalesce(h.hits,0) as hits, case when n_pred>0 then coalesce(h.hits,0)/n_pred else 0 end as p, case when n_true>0 then coalesce(h.hits,0)/n_true else 0 end as r
 from sides s left join hits h on h.lecture_id=s.lecture_id""",
)


@query("match_marks", sql("boards segments", """select lecture_id, hits, n_true, n_pred, round(p,6) as precision, round(r,6) as recall,
 round(case when p+r>0 then 2*p*r/(p+r) else 0 end,6) as f1 from prf""", recursive=True, **MATCH))
def _match(spark, sf):
    truth, pred = marks(spark, sf)
    out = J.match_marks(truth, pred, 10.0)
    return out.select("lecture_id", "hits", "n_true", "n_pred", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("missed_marks", sql("boards segments", """select b.lecture_id, b.start_s as t from boards b where not exists
 (select 1 from segments s where s.lecture_id=b.lecture_id and abs(s.start_s-b.start_s)<=10)"""))
def _missed(spark, sf):
    truth, pred = marks(spark, sf)
    return J.missed_marks(truth, pred, 10.0)
