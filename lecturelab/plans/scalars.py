"""Column helpers applied to whole sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.functions import text as X
from lecturelab.functions import timecode as C
from lecturelab.plans.oracle import cut, duration, num, rounded, sql, tc, usd, words
from lecturelab.plans.registry import query
from lecturelab.sources import tables as T

BACK = "list_reduce(list_transform(string_split(tc,':'), lambda v: try_cast(v as double)), lambda a,b: a*60+b)"


@query("timecodes", sql("asr", f"""select lecture_id, seq, tc, tc_hours, round({BACK},6) as seconds from (select lecture_id, seq, {tc('start_s/100')} as tc,
 (s//3600)||':'||lpad(cast(s%3600//60 as varchar),2,'0')||':'||lpad(cast(s%60 as varchar),2,'0') as tc_hours
 from (select *, cast(round_even(greatest(start_s/100,0),0) as bigint) as s from asr))"""))
def _timecodes(spark, sf):
    t = F.col("start_s") / 100
    rows = T.asr_segments(spark, sf).select("lecture_id", "seq", C.to_timecode(t).alias("tc"), C.to_timecode(t, True).alias("tc_hours"))
    return rows.withColumn("seconds", rounded(C.from_timecode(F.col("tc")), 6))


SRC = """case when page_id%3=0 then 'https://www.youtube.com/watch?t=1&v=abcdef-'||lpad(cast(page_id as varchar),4,'0') when page_id%3=1 then url else '/video/'||page_id||'.mp4' end"""


@query("video_links", sql("", f"""select page_id, prefix, prefix||cast(trunc(page_id*1.7) as bigint)||'s' as link, is_url from (
 select page_id, case when id<>'' then 'https://youtu.be/'||id||'?t=' when regexp_matches(src,'^https?://') and not contains(src,'&') and not contains(src,'?') then src||'?t=' end as prefix,
 regexp_matches(src,'(?i)^https?:') as is_url from (select page_id, src, regexp_extract(src, '(?:youtu\\.be/|youtube\\.com/(?:watch\\?(?:.*&)?v=|embed/|shorts/|live/))([A-Za-z0-9_-]{{11}})',1) as id
 from (select page_id, {SRC} as src from pages)))"""))
def _links(spark, sf):
    src = F.expr(SRC.replace("as varchar", "as string"))
    rows = T.table(spark, sf, "pages").select("page_id", src.alias("src"))
    return rows.select(
        "page_id", C.video_link_prefix(F.col("src")).alias("prefix"),
        C.video_link_at(F.col("src"), F.col("page_id") * 1.7).alias("link"), C.is_url(F.col("src")).alias("is_url"))


@query("truncate_words", sql("", f"select conv_id, turn, {cut('text', 20)} as short, len({words('text')}) as words from conversations"))
def _truncate(spark, sf):
    return T.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.truncate_words(F.col("text"), 20).alias("short"), X.word_count(F.col("text")).alias("words"))


SIZE = """case when v<1024 then cast(cast(round_even(v,0) as bigint) as varchar)||' Б' when v<1048576 then cast(cast(round_even(v/1024,0) as bigint) as varchar)||' КБ'
 when v<1073741824 then cast(cast(round_even(v/1048576*10,0)/10 as decimal(38,1)) as varchar)||' МБ' else cast(cast(round_even(v/1073741824*10,0)/10 as decimal(38,1)) as varchar)||' ГБ' end"""


@query("number_formats", sql("", f"""select event_id, {duration('x')} as took, {usd('y')} as price, {num('y', 3)} as num, {SIZE} as size from (
 select event_id, case when event_type='view' then null else value*value*8 end as x,
 case when event_type='click' then 0 when event_type='error' then value/100000 else value/7 end as y, pow(value,6)::double as v from events)"""))
def _formats(spark, sf):
    ev, v = T.table(spark, sf, "events"), F.col("value")
    x = F.when(F.col("event_type") != "view", v * v * 8)
    y = F.when(F.col("event_type") == "click", 0.0).when(F.col("event_type") == "error", v / 100000).otherwise(v / 7)
    return ev.select(
        "event_id", C.format_duration(x).alias("took"), C.format_usd(y).alias("price"), C.format_num(y, 3).alias("num"),
        C.human_size(F.pow(v, F.lit(6.0))).alias("size"))


@query("names", sql("", r"""select conv_id, turn, case when t='' then 'конспект' else substring(t,1,80) end as file,
 case when length(f)<=26 then f else rtrim(substring(f,1,25))||'…' end as short, substring(sha256('{"p0":'||conv_id||',"p1":'||turn||'}'),1,12) as key from (
 select conv_id, turn, f, regexp_replace(trim(regexp_replace(regexp_replace(text,'[<>:"/\\|?*]',' ','g'),'\s+',' ','g')),'^[ .]+|[ .]+$','','g') as t
 from (select *, trim(regexp_replace(text,'\s+',' ','g')) as f from conversations))"""))
def _names(spark, sf):
    text = F.col("text")
    return T.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.safe_filename(text).alias("file"), X.short_title(text).alias("short"),
        X.stable_key(F.col("conv_id"), F.col("turn")).alias("key"))


@query("note_timecodes", sql("segments", r"""select lecture_id, sid, array_to_string(list_transform(regexp_extract_all(body,'\\ts\{(\d{1,2}:\d{2}(?::\d{2})?)\}',1),
 lambda t: t||'='||cast(cast(string_split(t,':')[1] as int)*60+cast(string_split(t,':')[2] as int) as varchar)),',') as codes,
 replace(body, '\ts{0'||(sid%10)||':30}', '\ts['||(60*(sid%10)+30)||']{0'||(sid%10)||':30}') as expanded from segments"""))
def _notes(spark, sf):
    codes = F.transform(C.note_timecodes(F.col("body")), lambda t: F.concat(t["tc"], F.lit("="), t["seconds"].cast("long").cast("string")))
    return T.segments(spark, sf).select(
        "lecture_id", "sid", F.array_join(codes, ",").alias("codes"), C.with_seconds(F.col("body")).alias("expanded"))


@query("latex_escape", sql("", r"""select page_id, md5(array_to_string(list_transform(string_split(html,'\'), lambda x:
 replace(replace(regexp_replace(x,'([&%$#_{}])','\\\1','g'),'~','\textasciitilde{}'),'^','\textasciicircum{}')),'\textbackslash{}')) as escaped_md5 from pages"""))
def _escape(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", F.md5(X.latex_escape(F.col("html"))).alias("escaped_md5"))
