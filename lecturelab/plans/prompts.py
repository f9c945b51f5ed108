"""Prompt tables over the document recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.operators import intervals as J
from lecturelab.operators import prompts as P
from lecturelab.operators import resultstore
from lecturelab.operators.retrieval import expand_context
from lecturelab.plans.oracle import cut, sql, tc
from lecturelab.plans.registry import query
from lecturelab.session import scratch_path
from lecturelab.plans.retrieval import NEED, PASSAGES, RANKED, SCORES, SEG_BOARDS, search_hits
from lecturelab.plans.spans import AROUND
from lecturelab.session import materialise
from lecturelab.sources import tables as T

SAID = "select lecture_id, uid//12 as sid, string_agg(text,' ' order by uid) as transcript from speech group by 1,2"


def transcripts(spark, sf):
    return J.segment_transcript(T.segments(spark, sf), T.speech(spark, sf))


@query("board_prompts", sql("speech boards", f"""select a.lecture_id, a.bid, 'Frame at '||{tc('key_ts')}||case when said<>'' then chr(10)||'Speech around the frame:'||chr(10)||{cut('said', 220)} else '' end as prompt
 from around a join boards b using (lecture_id, bid)""", around=AROUND))
def _boards(spark, sf):
    boards = materialise(T.boards(spark, sf), "boards")
    return P.board_prompts(boards, J.speech_around_board(boards, T.speech(spark, sf, with_boards=True)))


EARLIER = dict(
    oks="select lecture_id, sid, sid//4 as wave, title, row_number() over (partition by lecture_id order by sid) as no from segments where title<>''",
    before="select s.lecture_id, s.sid, count(o.no) as c from segments s left join oks o on o.lecture_id=s.lecture_id and o.wave<s.sid//4 group by 1,2",
    previous="""select b.lecture_id, b.sid, coalesce(string_agg(o.title,'; ' order by o.no),'') as previous from before b left join oks o on o.lecture_id=b.lecture_id and o.no<=b.c and o.no>b.c-8 group by 1,2""",
)


def previous(segments):
    titles = segments.select("lecture_id", "sid", "title", (F.col("title") != "").alias("ok"))
    return P.earlier_titles(titles)


@query("earlier_titles", sql("segments", "select * from previous", **EARLIER))
def _earlier(spark, sf):
    return previous(materialise(T.segments(spark, sf), "segments"))


BLOCKS = dict(
    sb=SEG_BOARDS,
    blocks=f"""select lecture_id, sid, string_agg(b, chr(10) order by bid) as boards from (select lecture_id, sid, bid, '### '||{tc('key_ts')}||case when coalesce(confidence,0)<>0 then ' ('||cast(cast(round_even(confidence*100,0)/100 as decimal(10,2)) as varchar)||')' else '' end
 ||chr(10)||latex||case when coalesce(caption,'')<>'' then chr(10)||caption else '' end as b, row_number() over (partition by lecture_id, sid order by bid) as r from sb where coalesce(latex,'')<>'') where r<=6 group by 1,2""",
)


@query("section_prompts", sql("speech segments boards", f"""select s.lecture_id, s.sid, s.sid+1 as index, count(*) over (partition by s.lecture_id) as total, {tc('s.start_s')} as start_tc, {tc('s.end_s')} as end_tc,
 {cut('t.transcript', 2500)} as transcript, coalesce(b.boards,'') as boards, p.previous from segments s join said t using (lecture_id, sid) join previous p using (lecture_id, sid) left join blocks b using (lecture_id, sid)""",
    said=SAID, **EARLIER, **BLOCKS))
def _sections(spark, sf):
    segs = materialise(T.segments(spark, sf), "segments")
    found = J.boards_in(T.boards(spark, sf), segs.select("lecture_id", "sid", F.col("start_s").alias("span_start"), F.col("end_s").alias("span_end")))
    said = J.segment_transcript(segs, T.speech(spark, sf))
    return P.section_prompts(segs, said, P.section_boards(found), previous(segs))


#: The passages found for each question, with their neighbours, in time order.
CONTEXT = """select lecture_id, query_id, start_s, text, pos from (select *, row_number() over (partition by lecture_id, query_id order by start_s, cid) as pos from (
 select distinct h.lecture_id, h.query_id, l.uid as cid, l.start_s, l.text from ranked h join library l on h.lecture_id=l.lecture_id and l.uid between h.cid-1 and h.cid+1)) where pos<=12"""
FOUND = dict(fit_rows=PASSAGES, **SCORES, **RANKED, ctx=CONTEXT)


def retrieved(spark, sf):
    """(hits with their start, context) of every question."""
    chunks = T.library(spark, sf).select("lecture_id", F.col("uid").alias("cid"), "start_s", "text")
    hits = materialise(search_hits(spark, sf), "hits")
    near = expand_context(hits, chunks).withColumns({"title": F.lit("Untitled"), "board": F.lit(None).cast("string")})
    return hits.join(chunks.select("lecture_id", "cid", "start_s"), ["lecture_id", "cid"]), near


@query("qa_prompts", sql(NEED, f"""select q.lecture_id, q.query_id, string_agg('### ['||{tc('c.start_s')}||'] Untitled'||chr(10)||c.text, chr(10)||chr(10) order by c.pos)||chr(10)||chr(10)||'## Question'||chr(10)||min(q.question) as prompt
 from questions q join ctx c using (lecture_id, query_id) group by 1,2""", **FOUND))
def _qa(spark, sf):
    return P.qa_prompts(retrieved(spark, sf)[1], T.questions(spark, sf))


@query("quiz_groups", sql("talks", f"""select t.lecture_id, cast(t.uid//4 as int) as grp, greatest(1, cast(round_even(10.0::double/ceil(n.n/4),0) as int)) as per_group, count(*) as chunks,
 md5(string_agg('### ['||{tc('t.start_s')}||'] Turn'||chr(10)||{cut('t.text', 400)}, chr(10)||chr(10) order by t.uid)) as material_md5
 from talks t join (select lecture_id, count(*) as n from talks group by 1) n on n.lecture_id=t.lecture_id group by 1,2,3"""))
def _groups(spark, sf):
    chunks = T.talks(spark, sf).select("lecture_id", F.col("uid").alias("cid"), "start_s", F.lit("Turn").alias("title"), "text", F.lit(None).cast("string").alias("board"))
    return P.quiz_groups(chunks).select("lecture_id", "grp", "per_group", "chunks", F.md5("material").alias("material_md5"))


@query("summary_inputs", sql("speech segments", f"""select s.lecture_id, s.sid, {tc('s.start_s')} as tc, case when s.title='' then 'Раздел' else s.title end as title,
 case when len(string_split_regex(b.txt,'\\s+'))<=b.budget then b.txt else array_to_string(string_split_regex(b.txt,'\\s+')[1:b.budget],' ')||' …' end as body
 from segments s join (select s.lecture_id, s.sid, case when trim(s.body)<>'' then s.body else t.transcript end as txt,
 greatest(200, 12000//count(*) over (partition by s.lecture_id)) as budget from segments s join said t using (lecture_id, sid)) b on b.lecture_id=s.lecture_id and b.sid=s.sid""", said=SAID))
def _summary(spark, sf):
    return P.summary_inputs(T.segments(spark, sf), transcripts(spark, sf))


@query("summary_cache", sql("lectures", "select md5(title) as key, min(title) as title from lectures where not exists (select 1 from lectures s where s.asr_model='fake' and s.title=lectures.title) group by 1"))
def _cache(spark, sf):
    rows = T.lectures(spark, sf).withColumn("key", F.md5("title"))
    return P.summary_misses(rows, rows.where("asr_model = 'fake'")).select("key", "title")


@query("summary_store", sql("lectures", "select md5(title) as key, length(title)||' letters' as result, 1 as n from lectures group by title"))
def _store(spark, sf):
    """Titles of some recordings are answered first, then all, then all again; every title is stored once."""
    path = scratch_path(spark, "summaries")
    rows = T.lectures(spark, sf).select(F.md5("title").alias("key"), F.col("title").alias("prompt"), "asr_model").dropDuplicates(["key", "asr_model"])
    for part in (rows.where("asr_model = 'fake'"), rows, rows):
        resultstore.answer_once(part, lambda prompt: f"{len(prompt)} letters", path)
    return resultstore.stored_results(spark, path).groupBy("key", "result").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("infer", sql("talks", "select lecture_id, uid, case when words%5=0 then null else words||' words' end as result, case when words%5=0 then 'bad prompt' end as error from talks"))
def _infer(spark, sf):
    def fake(prompt: str) -> str:
        if len(prompt.split()) % 5 == 0:
            raise ValueError("bad prompt")
        return f"{len(prompt.split())} words"

    return P.infer(T.talks(spark, sf).withColumnRenamed("text", "prompt"), fake, ["lecture_id", "uid"])
