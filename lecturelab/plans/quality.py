"""LaTeX quality job over bodies made of the sample recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.operators import latex as L
from lecturelab.plans.oracle import sql
from lecturelab.plans.registry import query
from lecturelab.sources import tables as T

BODY = r"""case words%6 when 0 then text when 1 then text||' {' when 2 then '\begin{align} '||text when 3 then text||' \[ x' when 4 then '\begin{frame} '||text||' \end{frame}' else '\usepackage{x} '||text||' \end{proof}' end"""
NAMES = ",".join(f"'{name}'" for name in L.ENVIRONMENTS)


def _bodies(spark, sf):
    """A fragment per sentence, whole, with one kind of fault of its own or none."""
    return T.speech(spark, sf).select("lecture_id", "uid", "words", F.expr(BODY.replace("\\", "\\\\")).alias("body"))


def _judged(body: str) -> dict[str, str]:
    """The steps of the check over `fragments (lecture_id, uid, b)`, a fragment holding at most one environment."""
    times = lambda what: f"(length(n)-length(replace(n,'{what}','')))//{len(what)}"
    return dict(
        fragments=body,
        probes=f"select *, {CLEAN.replace('(f,', '(b,')} as n from fragments",
        found=r"select *, regexp_extract_all(n,'\\(?:begin|end)\{[^}]+\}') as marks from probes",
        named=r"select *, list_transform(marks, lambda m: trim(regexp_extract(m,'\{([^}]+)\}',1))) as envs from found",
        judged=f"""select *, list_filter([case when regexp_matches(n,'{L.FORBIDDEN}') then 'preamble-command' end,
 case when {times('{')}<>{times('}')} then 'brace-count: '||{times('{')}||'/'||{times('}')} end,
 case when len(list_filter(regexp_extract_all(n,'\\$+'), lambda d: length(d)=1))%2=1 then 'dollar-parity' end,
 case when {times(chr(92) + '[')}<>{times(chr(92) + ']')} then 'display-math-count' end,
 case when len(marks)=1 and marks[1] like '_end%' then 'end-without-begin: '||envs[1] end,
 case when len(marks)=1 and marks[1] like '_begin%' then 'begin-without-end: '||envs[1] end], lambda e: e is not null) as errors,
 list_transform(list_filter(envs, lambda e: e not in ({NAMES})), lambda e: 'unknown-environment: '||e) as warnings from named""")


NOISE = " \\% kept % dropped\nnext \\verb|{| \\begin{verbatim}}{\\end{verbatim}"
#: A comment may not follow a backslash; without look-behind the character before it is captured and put back.
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(f,'(?s)\\verb\|[^|]*\||\\begin\{verbatim\}.*?\\end\{verbatim\}',' ','g'),'(^|[^\\])%[^\n]*','\1','g'),'\\[\\{}$&#%_]',' ','g')"""


BODIES = f"select lecture_id, uid, {BODY} as b from sent_rows"


@query("latex_quality", sql("sent_rows", """select lecture_id, uid, len(errors)=0 as ok, array_to_string(errors,'; ') as errors,
 array_to_string(warnings,'; ') as warnings from judged""", **_judged(BODIES)))
def _quality(spark, sf):
    r = L.latex_quality(F.col("body"))
    return _bodies(spark, sf).select("lecture_id", "uid", r.alias("r")).select(
        "lecture_id", "uid", "r.ok", F.array_join("r.errors", "; ").alias("errors"), F.array_join("r.warnings", "; ").alias("warnings"))


@query("latex_quality_report", sql("sent_rows", """select lecture_id, string_split(e,':')[1] as error, count(*) as n
 from (select lecture_id, unnest(errors) as e from judged) group by 1,2""", **_judged(BODIES)))
def _report(spark, sf):
    return L.latex_quality_report(_bodies(spark, sf).select("lecture_id", "body"))


@query("latex_strip_noise", sql("speech", f"select lecture_id, uid, {CLEAN} as clean from (select lecture_id, uid, text||'{NOISE}' as f from speech)"))
def _strip(spark, sf):
    """Whole sentences as they are, with every kind of noise behind them."""
    rows = T.speech(spark, sf).select("lecture_id", "uid", F.concat("text", F.lit(NOISE)).alias("f"))
    return rows.select("lecture_id", "uid", L.latex_strip_noise(F.col("f")).alias("clean"))


#: Without the preamble command and with display math, as the fragments have no other command to settle.
PLAIN = r"""trim(regexp_replace(replace(b,'\usepackage',''),'(?s)\$\$(.+?)\$\$','\\[\1\\]','g'))"""
SANE = rf"""'{{a}}\[x\]'||chr(10)||chr(10)||'\begin{{note}}'||chr(10)||{PLAIN}||chr(10)||'\end{{note}}'"""


@query("latex_sanitise", sql("sent_rows", f"select lecture_id, uid, {SANE} as clean from fragments", fragments=BODIES))
def _sanitise(spark, sf):
    fenced = F.concat(F.lit("```latex\n\\usepackage{a}$$x$$\n\n\n\n\\note "), "body", F.lit("\n```"))
    return _bodies(spark, sf).select("lecture_id", "uid", L.latex_sanitise(fenced).alias("clean"))


QUOTED = r"""'\begin{quote}'||chr(10)||'LaTeX: '||array_to_string(errors,'; ')||'\par'||chr(10)||regexp_replace(replace(b,'\','\textbackslash '),'([{}$&#_%])','\\\1','g')||chr(10)||'\end{quote}'"""


@query("latex_repair", sql("sent_rows", f"select lecture_id, uid, case when len(errors)=0 then b else {QUOTED} end as body, len(errors)=0 as ok, array_to_string(errors,'; ') as errors from judged",
                           raw=BODIES, **_judged(f"select lecture_id, uid, {PLAIN} as b from raw")))
def _repair(spark, sf):
    r = L.latex_repair(F.col("body"))
    return _bodies(spark, sf).select("lecture_id", "uid", r.alias("r")).select("lecture_id", "uid", "r.body", "r.ok", F.array_join("r.errors", "; ").alias("errors"))
