"""Parsing and checking of model replies, made from the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.functions.timecode import to_timecode
from lecturelab.operators import answers as N
from lecturelab.plans.oracle import rounded, sql, tc
from lecturelab.plans.prompts import FOUND, retrieved
from lecturelab.plans.registry import query
from lecturelab.plans.retrieval import NEED
from lecturelab.sources import tables as T

REPLY = """case k%5 when 0 then '{"kind":"slide","latex":" '||k||' ","confidence":"0.5"}' when 1 then 'Here:'||chr(10)||'```json'||chr(10)||'{"kind":"empty","caption":"x"}'||chr(10)||'```'
 when 2 then 'Sure: {"kind":"mixed","latex":"","confidence":"high"} as asked' when 3 then 'list [1, '||k||'] done' else 'no json {'||k||'} here' end"""


def _replies(spark, sf):
    rows = T.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    reply = F.expr(REPLY.replace("case k%5 when", "case k % 5 when").replace("chr(10)", "chr(10)").replace("'||k||'", "'||cast(k as string)||'"))
    return rows.select("event_id", "k", reply.alias("reply"))


@query("extract_json", sql("", """select event_id, case k%5 when 0 then reply when 1 then '{"kind":"empty","caption":"x"}' when 2 then '{"kind":"mixed","latex":"","confidence":"high"}' when 3 then '[1, '||k||']' end as json
 from (select event_id, k, """ + REPLY + """ as reply from (select event_id, cast(json_extract_string(props,'$.k') as int) as k from events))"""))
def _json(spark, sf):
    return _replies(spark, sf).select("event_id", N.extract_json(F.col("reply")).alias("json"))


@query("apply_board_payload", sql("", """select event_id, case k%5 when 0 then 'slide' when 2 then 'mixed' else 'unknown' end as kind, case when k%5=0 then k::varchar end as latex, case when k%5=1 then 'x' end as caption,
 case k%5 when 0 then 0.5::double when 2 then null else 0.0::double end as confidence from (select event_id, cast(json_extract_string(props,'$.k') as int) as k from events)"""))
def _payload(spark, sf):
    parsed = F.from_json(N.extract_json(F.col("reply")), "kind string, latex string, caption string, confidence string")
    rows = _replies(spark, sf).select("event_id", F.when(F.col("k") % 5 < 3, parsed).alias("payload"))
    return N.apply_board_payload(rows)


#: A reply to each question: it cites the best passage twice, a time far past it, and a fixed one.
ANSWER = f"' See ['||{tc('l.start_s')}||'] and ['||{tc('l.start_s+100000')}||'] or [1:02:03] or ['||{tc('l.start_s')}||']. '"


def _answers(hits):
    best = hits.where("rank = 1")
    at, later = to_timecode(F.col("start_s")), to_timecode(F.col("start_s") + 100_000)
    return best.select("lecture_id", "query_id", F.concat(
        F.lit(" See ["), at, F.lit("] and ["), later, F.lit("] or [1:02:03] or ["), at, F.lit("]. ")).alias("text"))


SECS = "list_reduce(list_transform(string_split(t,':'), lambda v: cast(v as double)), lambda a,b: a*60+b)"
CITED = dict(
    FOUND, hit="select h.*, l.start_s from ranked h join library l on h.lecture_id=l.lecture_id and h.cid=l.uid",
    ans=f"select l.lecture_id, l.query_id, {ANSWER} as text from hit l where rank=1",
    cited=f"""select lecture_id, query_id, i, t, {SECS} as s from (select lecture_id, query_id, unnest(regexp_extract_all(text,'\\[(\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?)\\]',1)) as t,
 generate_subscripts(regexp_extract_all(text,'\\[(\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?)\\]',1),1) as i from ans)""",
    judged="select c.*, exists (select 1 from ctx x where x.lecture_id=c.lecture_id and x.query_id=c.query_id and abs(x.start_s-c.s)<=180) as ok from cited c",
    verified=f"""select a.lecture_id, a.query_id, trim(a.text) as text,
 coalesce((select string_agg(s::bigint::varchar,',' order by s) from (select distinct s from judged j where j.lecture_id=a.lecture_id and j.query_id=a.query_id and ok)),'') as citations,
 coalesce((select string_agg(t,',' order by i) from judged j where j.lecture_id=a.lecture_id and j.query_id=a.query_id and not ok),'') as unsupported,
 coalesce((select string_agg({tc('x.start_s')}||'='||cast(cast(round_even(1000.0::double*x.score,0)/1000 as decimal(20,3)) as varchar),', ' order by x.rank) from hit x where x.lecture_id=a.lecture_id and x.query_id=a.query_id),'') as sources from ans a""",
)


def _verified(spark, sf):
    hits, near = retrieved(spark, sf)
    return N.verify_citations(_answers(hits), near, hits.select("lecture_id", "query_id", "rank", "start_s", "score"))


@query("verify_citations", sql(NEED, "select lecture_id, query_id, text, citations, unsupported, sources from verified", **CITED))
def _verify(spark, sf):
    return _verified(spark, sf)


@query("qa_answer_rows", sql(NEED, """select lecture_id, query_id, text, regexp_replace(sources,'=[^,]*','','g') as sources,
 case when unsupported<>'' then 'Метки вне найденных фрагментов: '||replace(unsupported,',',', ') else '' end as warning from verified""", **CITED))
def _rows(spark, sf):
    return N.answer_rows(_verified(spark, sf))


@query("chat_history", sql("", """select lecture_id, cast(row_number() over (partition by lecture_id order by query_id, half)-1 as int) as turn, role, content from (
 select 'u'||user_id as lecture_id, event_id as query_id, 0 as half, 'user' as role, 'About '||event_type as content from events union all
 select 'u'||user_id, event_id, 1, 'assistant', 'It is '||value from events)"""))
def _chat(spark, sf):
    ev = T.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lecture_id"), F.col("event_id").alias("query_id"), "event_type", "value")
    q = ev.select("lecture_id", "query_id", F.concat(F.lit("About "), "event_type").alias("question"))
    a = ev.select("lecture_id", "query_id", F.concat(F.lit("It is "), F.col("value").cast("string")).alias("text"))
    return N.chat_history(q, a)


def _raw_items(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    ks = k.cast("string")
    options = F.when(k % 10 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(
        F.array(F.col("event_type"), F.concat(F.lit(" "), ks), (k % 3).cast("string"), F.lit("none ")))
    return T.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lecture_id"), F.col("event_id").alias("batch"), F.lit(0).alias("pos"),
        F.concat(F.lit(" Q"), ks, F.lit(" ")).alias("question"), options.alias("options"), (k % 6).cast("string").alias("answer_index"),
        F.when(k % 13 == 0, F.lit("soon")).otherwise((F.col("value") * 10).cast("string")).alias("ref_ts"),
        F.get(F.array(F.lit("recall"), F.lit("apply"), F.lit("analyse"), F.lit("hard")), k % 5).alias("difficulty"))


QUIZ = dict(
    raw_="select 'u'||user_id as lecture_id, event_id as batch, event_type, value, cast(json_extract_string(props,'$.k') as int) as k from events",
    good="""select w.lecture_id, batch, 'Q'||k as question, event_type||'|'||k||'|'||(k%3)||'|none' as options, k%6 as answer_index,
 case when r.duration>0 then least(value*10, r.duration) else value*10 end as ref_ts, case k%5 when 1 then 'apply' when 2 then 'analyse' else 'recall' end as difficulty
 from raw_ w left join recordings r using (lecture_id) where k%10<>0 and k%3<>k and k%6<4 and k%13<>0""",
    quiz="select *, cast(row_number() over (partition by lecture_id order by ref_ts, batch) as int) as item from good qualify item<=10",
)


def _quiz(spark, sf):
    return N.validate_quiz(_raw_items(spark, sf), T.recordings(spark, sf), 10)


@query("validate_quiz", sql("recordings", "select lecture_id, item, question, options, answer_index, round(ref_ts,6) as ref_ts, difficulty from quiz", **QUIZ))
def _validate(spark, sf):
    return _quiz(spark, sf).select(
        "lecture_id", "item", "question", F.array_join("options", "|").alias("options"), "answer_index", rounded("ref_ts", 6).alias("ref_ts"), "difficulty")


@query("score_quiz", sql("recordings", "select lecture_id, count(*) filter (item%4=answer_index) as correct, count(*) as total from quiz group by 1", **QUIZ))
def _score(spark, sf):
    items = _quiz(spark, sf)
    return N.score_quiz(items, items.select("lecture_id", "item", (F.col("item") % 4).alias("choice")))


@query("difficulty_mix", sql("recordings", """select lecture_id, difficulty, count(*) as n, round(count(*)/sum(count(*)) over (partition by lecture_id),6) as share,
 round(count(*)/sum(count(*)) over (partition by lecture_id)-case difficulty when 'recall' then 1/2 when 'apply' then 1/3 else 1/6 end,6) as off_target from quiz group by 1,2""", **QUIZ))
def _mix(spark, sf):
    return N.difficulty_mix(_quiz(spark, sf)).withColumns({"share": rounded("share", 6), "off_target": rounded("off_target", 6)})


@query("quiz_text", sql("recordings", f"""select lecture_id, string_agg(item||'. ['||{tc('ref_ts')}||'] ('||difficulty||') '||question||chr(10)||'   А) '||o[1]||chr(10)||'   Б) '||o[2]||chr(10)||'   В) '||o[3]||chr(10)||'   Г) '||o[4]
 ||chr(10)||'   -> '||(['А','Б','В','Г'])[answer_index+1]||'. '||chr(10), chr(10) order by item) as quiz from (select *, string_split(options,'|') as o from quiz) group by 1""", **QUIZ))
def _text(spark, sf):
    items = _quiz(spark, sf).withColumn("explanation", F.lit(""))
    return N.quiz_text(items, True)


def _sections(spark, sf):
    segs = T.segments(spark, sf)
    payloads = segs.where(F.col("body") != "").select(
        "lecture_id", "sid", F.when(F.col("sid") % 2 == 0, F.concat(F.lit(" "), "title", F.lit(" "))).alias("new_title"),
        F.when(F.col("sid") % 5 == 0, F.concat("body", F.lit(" {"))).otherwise(F.col("body")).alias("latex"))
    return N.apply_section_payload(segs, payloads)


@query("apply_section_payload", sql("segments", f"""select lecture_id, sid, body='' as failed, case when body<>'' and sid%2=0 and title<>'' then title when body<>'' then 'Раздел '||(sid+1)
 when title<>'' then title else 'Фрагмент '||{tc('start_s')} end as title, body<>'' and sid%5=0 as broken from segments"""))
def _apply(spark, sf):
    return _sections(spark, sf).select("lecture_id", "sid", "failed", "title", (F.size("errors") > 0).alias("broken"))


@query("compose_report", sql("segments", "select lecture_id, count(*) as sections, count(*) filter (body='' or sid%5=0) as sections_with_problems from segments group by 1"))
def _compose(spark, sf):
    return N.compose_report(_sections(spark, sf))
