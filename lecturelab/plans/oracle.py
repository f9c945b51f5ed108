"""Shared SQL text for the reference results: the same recordings written for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lecturelab.functions.text import SPACE

CTES: dict[str, str] = {
    "sents": r"""select doc_id, 'd'||doc_id as lecture_id, source, lang,
 list_filter(list_transform(regexp_extract_all(text,'[^.!?\n]+[.!?]*'), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'') as s
 from documents""",
    "sent_rows": r"""select lecture_id, doc_id, cast(i-1 as int) as uid, t as text,
 cast(len(list_filter(regexp_split_to_array(t,'\s+'), lambda x: x<>'')) as int) as words
 from (select lecture_id, doc_id, unnest(s) as t, generate_subscripts(s,1) as i from sents)""",
    "speech": """select lecture_id, uid, cast(400*cw-400*words+300*uid as double)/1000 as start_s,
 cast(400*cw+300*uid as double)/1000 as end_s, text, words
 from (select *, sum(words) over (partition by lecture_id order by uid) as cw from sent_rows)""",
    "talks": r"""select lecture_id, uid, cast(cum-dur as double)/1000 as start_s, cast(cum-300 as double)/1000 as end_s, text, words
 from (select *, sum(dur) over (partition by lecture_id order by uid) as cum from
 (select *, 400*words+300 as dur from (select 'c'||conv_id as lecture_id, cast(turn as int) as uid, text,
 cast(len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')) as int) as words from conversations)))""".replace("\\\\s", "\\s"),
    "library": """select lecture_id, uid, cast(uid*20 as double) as start_s, cast(uid*20+18 as double) as end_s, text, lang
 from (select source as lecture_id, cast(row_number() over (partition by source order by doc_id)-1 as int) as uid, text, lang from documents)""",
    "questions": """select 'src'||(item_id%20) as lecture_id, cast(item_id as int) as query_id, text as question from benchmark""",
    "asr": """select 'u'||user_id as lecture_id, cast(row_number() over (partition by user_id order by event_id)-1 as int) as seq,
 cast(epoch_us(ts)-1704067200000000 as double)/1e6 as start_s, cast(epoch_us(ts)-1704067200000000 as double)/1e6+value as end_s,
 case when event_type='error' then 'da da da da da da da' when event_type='view' then '   '
 when event_type='signup' then event_type||' and then' else event_type||' ok.' end as text,
 -value/100 as avg_logprob, cast(json_extract_string(props,'$.k') as double)/100 as no_speech_prob from events""",
    "durations": """select lecture_id, doc_id, (400*sum(words)+300*(count(*)-1))/1000.0::double as seconds from sent_rows group by 1,2""",
    "boards": """select lecture_id, bid, cast(bid*60 as double) as start_s, cast(bid*60+60 as double) as end_s, cast(bid*60+45 as double) as key_ts,
 'frames/board_'||bid||'.png' as frame_path,
 case when q=1 and bid%3<>2 then '$x_{'||doc_id||'}$' end as latex, case when q=1 then 'derivation' end as caption,
 case when q=1 then 0.9::double when bid%2=0 then 0.4::double else 0.2::double end as confidence
 from (select d.lecture_id, d.doc_id, l.quality as q, cast(unnest(range(0, cast(floor(d.seconds/60) as bigint)+1)) as int) as bid
 from durations d join labels l on d.doc_id=l.doc_id)""",
    "segments": r"""select lecture_id, sid, min(start_s) as start_s, max(end_s) as end_s,
 case when sid%4=3 then '' else 'Part '||sid end as title,
 case when sid%3=1 then '' else '\section{Part} see \ts{0'||(sid%10)||':30} now' end as body
 from (select *, uid//12 as sid from speech) group by lecture_id, sid""",
    "lectures": """select s.doc_id, s.lecture_id, '/video/'||source||'/'||s.doc_id||'.mp4' as source,
 case when lang='en' then '' else 'Lecture '||source||'  in  '||lang end as title,
 coalesce(d.seconds, 0.0::double) as duration, case when lang='es' then 'fake' else 'small' end as asr_model
 from sents s left join durations d on s.doc_id=d.doc_id""",
    "usage": """select 'u'||user_id as lecture_id, event_type as stage,
 case when event_type='click' then '' when event_type='error' then 'm-unknown' when event_type='view' then 'm-small' else 'm-large' end as model,
 1 as calls, cast(floor(value*100) as bigint) as input_tokens, cast(json_extract_string(props,'$.k') as bigint)*10 as output_tokens, ts from events""",
    "timings": """select 'u'||user_id as lecture_id, case event_type when 'signup' then 'ingest' when 'view' then 'asr' when 'error' then 'boards'
 when 'click' then 'board_reading' when 'purchase' then 'compose' end as stage, value as seconds from events""",
    "recordings": """select 'u'||user_id as lecture_id, 'Recording of user number '||user_id||' about analysis' as title,
 case when user_id%17=0 then 0.0::double else sum(cast(floor(value*10) as bigint))/10.0::double end as duration,
 cast(user_id%7 as int) as boards, cast(user_id%5 as int) as segments, case when user_id%11=0 then 'fake' else 'small' end as asr_model
 from events group by user_id""",
    "frames": """select 'l'||label as lecture_id, cast(row_number() over (partition by label order by vec_id)-1 as int) as frame_idx, embedding from embeddings""",
    "px": """select lecture_id, frame_idx, cast((i-1)//8 as int) as y, cast((i-1)%8 as int) as x from frames, range(1,65) t(i) where embedding[i]>0""",
    "vectors": """select 'l'||label as lecture_id, cast(vec_id as int) as cid, embedding from embeddings""",
    "flags": """select lecture_id, uid as pos, coalesce(cast(lang <> lag(lang) over (partition by lecture_id order by uid) as int),0) as ref,
 cast(uid%7=0 and uid>0 as int) as hyp from library""",
    "rates": """select * from (values ('m-small',1.0::double,5.0::double),('m-large',3.0::double,15.0::double)) t(model,rate_in,rate_out)""",
    "billed": """select u.*, case when u.model='' then 'm-large' else u.model end as billed_model, u.model='' as model_assumed from usage u""",
    "priced": """select b.*, (input_tokens*coalesce(rate_in,0)+output_tokens*coalesce(rate_out,0))/1e6 as cost_usd
 from billed b left join rates r on b.billed_model=r.model""",
    # weights of term vectors, one fit per recording, over table `fit_rows(lecture_id,row_id,text)`
    "fit_tokens": r"""select lecture_id, row_id, regexp_extract_all(lower(text),'[\p{L}\p{N}_]{2,}') as t from fit_rows""",
    "fit_terms": """select lecture_id, row_id, term, count(*) as tf from (
 select lecture_id, row_id, unnest(t) as term from fit_tokens union all
 select lecture_id, row_id, unnest(list_transform(range(1,len(t)), lambda i: t[i]||' '||t[i+1])) from fit_tokens) group by all""",
    "fit_n": "select lecture_id, count(*) as n from fit_rows group by 1",
    "fit_idf": """select lecture_id, term, df, ln((1+n)/(1.0+df))+1 as idf from (select lecture_id, term, count(*) as df from fit_terms group by 1,2) join fit_n using (lecture_id)""",
    "fit_w": """select lecture_id, row_id, term, raw/sqrt(sum(raw*raw) over (partition by lecture_id,row_id)) as w from
 (select lecture_id, row_id, term, (1+ln(tf))*idf as raw from fit_terms join fit_idf using (lecture_id,term))""",
}

DEPENDS: dict[str, list[str]] = {
    "sent_rows": ["sents"], "speech": ["sent_rows"], "durations": ["sent_rows"], "boards": ["durations"],
    "segments": ["speech"], "lectures": ["sents", "durations"], "px": ["frames"], "flags": ["library"],
    "billed": ["usage"], "priced": ["billed", "rates"],
    "fit_tokens": ["fit_rows"], "fit_terms": ["fit_tokens"], "fit_n": ["fit_rows"],
    "fit_idf": ["fit_terms", "fit_n"], "fit_w": ["fit_idf", "fit_terms"],
}


def sql(needs: str, body: str, recursive: bool = False, **local: str) -> str:
    """`body` behind the shared CTEs named in `needs`, then `local` ones in the given order."""
    done: list[str] = []
    parts: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dep in DEPENDS.get(name, []):
            add(dep)
        done.append(name)
        text = local.pop(name) if name in local else CTES[name]
        parts.append(f"{name} as ({text})")

    for name in needs.split():
        add(name)
    for name, text in list(local.items()):
        if name not in done:
            done.append(name)
            parts.append(f"{name} as ({text})")
    head = "with recursive " if recursive else "with "
    out = head + ",\n".join(parts) + "\n" + body if parts else body
    return out.replace(r"\s+", f"{SPACE}+")


def rounded(value: Column | str, digits: int) -> Column:
    """Half away from zero on the scaled binary value, as DuckDB's `round`: one rounding, alike on both sides."""
    value, scale = F.col(value) if isinstance(value, str) else value, float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def tc(x: str) -> str:
    """Time code of a seconds expression."""
    t = f"cast(round_even(greatest({x},0),0) as bigint)"
    return (
        f"(case when {t}>=3600 then ({t}//3600)||':'||lpad(cast({t}%3600//60 as varchar),2,'0')||':'||lpad(cast({t}%60 as varchar),2,'0') "
        f"else lpad(cast({t}//60 as varchar),2,'0')||':'||lpad(cast({t}%60 as varchar),2,'0') end)"
    )


def fixed(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"cast(cast(round_even(({x})*{scale},0)/{scale} as decimal(38,{digits})) as varchar)"


def num(x: str, digits: int) -> str:
    return f"regexp_replace({fixed(x, digits)}, '\\.?0+$', '')"


def usd(x: str) -> str:
    return f"(case when ({x}) is null then '—' when ({x})=0 then '$0' when ({x})<0.01 then '$'||{fixed(x, 4)} else '$'||{fixed(x, 2)} end)"


def duration(x: str) -> str:
    t = f"cast(round_even(greatest({x},0),0) as bigint)"
    return (
        f"(case when ({x}) is null then '—' when {t}<60 then {t}||' с' when {t}>=3600 then ({t}//3600)||' ч '||lpad(cast({t}%3600//60 as varchar),2,'0')||' мин' "
        f"else ({t}//60)||' мин '||lpad(cast({t}%60 as varchar),2,'0')||' с' end)"
    )


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x},'\\s+'), lambda x: x<>'')"


def cut(x: str, n: str | int) -> str:
    return f"(case when len({words(x)})<={n} then {x} else array_to_string({words(x)}[1:{n}],' ')||' …' end)"
