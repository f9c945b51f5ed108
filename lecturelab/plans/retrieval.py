"""Chunking and search over the sample recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.functions.timecode import to_timecode
from lecturelab.operators import retrieval as R
from lecturelab.operators import searchindex as X
from lecturelab.operators.intervals import neighbour_chunks
from lecturelab.operators.termvectors import most_frequent, term_counts, tfidf
from lecturelab.plans.oracle import rounded, sql, tc
from lecturelab.plans.registry import query
from lecturelab.sources import tables as T

PASSAGES = "select lecture_id, uid as row_id, text from library"

SCORES = dict(
    q_tokens=r"select lecture_id, query_id, regexp_extract_all(lower(question),'[\p{L}\p{N}_]{2,}') as t from questions",
    q_terms="""select lecture_id, query_id, term, count(*) as tf from (select lecture_id, query_id, unnest(t) as term from q_tokens union all
 select lecture_id, query_id, unnest(list_transform(range(1,len(t)), lambda i: t[i]||' '||t[i+1])) from q_tokens) group by all""",
    q_w="""select lecture_id, query_id, term, raw/sqrt(sum(raw*raw) over (partition by lecture_id,query_id)) as qw from
 (select lecture_id, query_id, term, (1+ln(tf))*idf as raw from q_terms join fit_idf using (lecture_id,term))""",
    scores="""select lecture_id, query_id, row_id as cid, round(sum(w*qw),9) as score from fit_w join q_w using (lecture_id,term) group by 1,2,3""",
)
RANKED = dict(
    ranked="""select lecture_id, query_id, r as rank, cid, score from (select q.lecture_id, q.query_id, p.row_id as cid, coalesce(s.score,0) as score,
 row_number() over (partition by q.lecture_id, q.query_id order by coalesce(s.score,0) desc, p.row_id) as r
 from questions q join fit_rows p on q.lecture_id=p.lecture_id left join scores s on s.lecture_id=q.lecture_id and s.query_id=q.query_id and s.cid=p.row_id)
 where r<=6 and (score>0.05 or r=1)""",
)
NEED = "library questions fit_rows fit_w"


def _passages(spark, sf):
    return T.library(spark, sf).select("lecture_id", F.col("uid").alias("row_id"), "text")


def search_hits(spark, sf):
    rows, asked = _passages(spark, sf), T.questions(spark, sf)
    return R.search_topk(R.sparse_scores(rows, asked, None), asked, rows)


@query("tokenize_ngrams", sql(
    "talks fit_rows fit_tokens", "select lecture_id, row_id, term, tf from fit_terms",
    fit_rows="select lecture_id, uid as row_id, text from talks",
    fit_terms="""select lecture_id, row_id, term, count(*) as tf from (
 select lecture_id, row_id, unnest(t) as term from fit_tokens union all
 select lecture_id, row_id, unnest(list_transform(range(1,len(t)), lambda i: t[i]||' '||t[i+1])) from fit_tokens) group by all"""))
def _tokens(spark, sf):
    return term_counts(T.talks(spark, sf).withColumnRenamed("uid", "row_id"))


@query("tfidf", sql("talks fit_rows fit_w", "select lecture_id, row_id, term, round(w,6) as w from fit_w",
                    fit_rows="select lecture_id, uid as row_id, text from talks"))
def _tfidf(spark, sf):
    return tfidf(T.talks(spark, sf).withColumnRenamed("uid", "row_id")).withColumn("w", rounded("w", 6))


CAP = 200


@query("vocabulary_cap", sql(
    "talks fit_rows fit_terms", f"""select lecture_id, term, df, total from (select *, row_number() over (partition by lecture_id order by total desc, term) as r from
 (select lecture_id, term, count(*) as df, cast(sum(tf) as bigint) as total from fit_terms group by 1,2)) where r<={CAP}""",
    fit_rows="select lecture_id, uid as row_id, text from talks"))
def _cap(spark, sf):
    counts = term_counts(T.talks(spark, sf).withColumnRenamed("uid", "row_id"))
    terms = counts.groupBy("lecture_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return most_frequent(terms, CAP)


@query("sparse_scores", sql(NEED, "select lecture_id, query_id, cid, round(score,6) as score from scores", fit_rows=PASSAGES, **SCORES))
def _sparse(spark, sf):
    return R.sparse_scores(_passages(spark, sf), T.questions(spark, sf), None).withColumn("score", rounded("score", 6))


@query("search_topk", sql(NEED, f"""select h.lecture_id, h.query_id, h.rank, h.cid, round(h.score,6) as score, {tc('l.start_s')} as tc
 from ranked h join library l on h.lecture_id=l.lecture_id and h.cid=l.uid""", fit_rows=PASSAGES, **SCORES, **RANKED))
def search(spark, sf):
    hits = search_hits(spark, sf)
    starts = T.library(spark, sf).select("lecture_id", F.col("uid").alias("cid"), "start_s")
    return hits.join(starts, ["lecture_id", "cid"]).select(
        "lecture_id", "query_id", "rank", "cid", rounded("score", 6).alias("score"), to_timecode(F.col("start_s")).alias("tc"))


@query("neighbour_chunks", sql("vectors", """select a.lecture_id, a.cid as hit_cid, b.cid from vectors a join vectors b
 on a.lecture_id=b.lecture_id and b.cid between a.cid-2 and a.cid+2"""))
def _neighbours(spark, sf):
    v = T.vectors(spark, sf).select("lecture_id", "cid")
    return neighbour_chunks(v, v, 2)


@query("expand_context", sql(NEED, """select lecture_id, query_id, cid, pos from (select *, row_number() over (partition by lecture_id, query_id order by start_s, cid) as pos from
 (select distinct h.lecture_id, h.query_id, l.uid as cid, l.start_s from ranked h join library l on h.lecture_id=l.lecture_id and l.uid between h.cid-1 and h.cid+1)) where pos<=12""",
    fit_rows=PASSAGES, **SCORES, **RANKED))
def _expand(spark, sf):
    chunks = T.library(spark, sf).select("lecture_id", F.col("uid").alias("cid"), "start_s")
    return R.expand_context(search_hits(spark, sf), chunks).select("lecture_id", "query_id", "cid", "pos")


# every recording's first frame is the question put to the recording
FIRST = "select lecture_id, query_id, embedding as q from (select lecture_id, cid as query_id, embedding, row_number() over (partition by lecture_id order by cid) as r from vectors) where r=1"
DENSE = "select v.lecture_id, f.query_id, v.cid, round(list_cosine_similarity(v.embedding::double[], f.q::double[]),9) as dense from vectors v join firsts f using (lecture_id)"


def _first_vectors(spark, sf):
    v = T.vectors(spark, sf)
    first = v.groupBy("lecture_id").agg(F.min_by(F.struct("cid", "embedding"), "cid").alias("f"))
    return v, first.select("lecture_id", F.col("f.cid").alias("query_id"), F.col("f.embedding").alias("embedding"))


@query("dense_scores", sql("vectors", "select lecture_id, query_id, cid, round(dense,6) as dense from dense", firsts=FIRST, dense=DENSE))
def _dense(spark, sf):
    return R.dense_scores(*_first_vectors(spark, sf)).withColumn("dense", rounded("dense", 6))


# real words and real vectors: each passage has the vector of its document's number, if any, each question that of its own
MIXED = dict(
    **SCORES,
    lib_vec="""select l.lecture_id, l.row_id, e.embedding from (select source as lecture_id, doc_id, cast(row_number() over (partition by source order by doc_id)-1 as int) as row_id
 from documents) l join embeddings e on e.vec_id=l.doc_id""",
    q_vec="select lecture_id, query_id, e.embedding as q from questions join embeddings e on e.vec_id=query_id",
    pairs="""select lecture_id, query_id, row_id as cid, round(list_cosine_similarity(v.embedding::double[], f.q::double[]),9) as dense from lib_vec v join q_vec f using (lecture_id)""",
)


@query("hybrid_scores", sql(NEED, """select lecture_id, query_id, cid, round(0.5*coalesce(score,0)+0.5*dense,6) as score from pairs left join scores using (lecture_id, query_id, cid)""",
                            fit_rows=PASSAGES, **MIXED))
def _hybrid(spark, sf):
    """Every passage with a vector against every question put to its recording; `hybrid_search` finds the best without that."""
    vectors = T.passage_vectors(spark, sf).withColumnRenamed("row_id", "cid")
    sparse = R.sparse_scores(_passages(spark, sf), T.questions(spark, sf))
    return R.hybrid_scores(sparse, R.dense_scores(vectors, T.question_vectors(spark, sf))).withColumn("score", rounded("score", 6))


BEST = """select lecture_id, query_id, cast(r as int) as rank, cid, round(score,6) as score from (
 select *, row_number() over (partition by lecture_id, query_id order by score desc, cid) as r from {}) where r<=6 and (score>0.05 or r=1)"""


@query("search_index", sql(NEED, "select lecture_id, query_id, cast(rank as int) as rank, cid, round(score,6) as score from ranked", fit_rows=PASSAGES, **SCORES, **RANKED))
def _indexed(spark, sf):
    """The index is built once and opened by its path for two batches of questions."""
    path = X.build_index(_passages(spark, sf)).path
    asked = T.questions(spark, sf)
    first, second = (X.search_index(X.open_index(spark, path), asked.where(F.col("query_id") % 2 == odd)) for odd in (0, 1))
    return first.unionByName(second).withColumn("score", rounded("score", 6))


@query("hybrid_search", sql(NEED, BEST.format("mixed"), fit_rows=PASSAGES, **MIXED, mixed="""
 select q.lecture_id, q.query_id, p.row_id as cid, round(0.5*coalesce(s.score,0)+0.5*coalesce(d.dense,0),9) as score from questions q join fit_rows p on p.lecture_id=q.lecture_id
 left join scores s on s.lecture_id=q.lecture_id and s.query_id=q.query_id and s.cid=p.row_id
 left join pairs d on d.lecture_id=q.lecture_id and d.query_id=q.query_id and d.cid=p.row_id"""))
def _hybrid_search(spark, sf):
    index = X.build_index(_passages(spark, sf), vectors=T.passage_vectors(spark, sf))
    found = X.search_index(index, T.questions(spark, sf), vectors=T.question_vectors(spark, sf))
    return found.withColumn("score", rounded("score", 6))


@query("dense_search", sql("vectors", BEST.format("(select lecture_id, query_id, cid, dense as score from dense)"), firsts=FIRST, dense=DENSE))
def _dense_search(spark, sf):
    """By vectors alone: passages and questions without words."""
    chunks, asked = _first_vectors(spark, sf)
    index = X.build_index(chunks.select("lecture_id", F.col("cid").alias("row_id"), F.lit("").alias("text")), vectors=chunks.withColumnRenamed("cid", "row_id"))
    questions = asked.select("lecture_id", "query_id", F.lit("").alias("question"))
    return X.search_index(index, questions, vectors=asked, weight=1.0).withColumn("score", rounded("score", 6))


SEG_BOARDS = """select s.lecture_id, s.sid, b.bid, b.latex, b.caption, b.confidence, b.key_ts from segments s join boards b
 on s.lecture_id=b.lecture_id and b.key_ts>=s.start_s and b.key_ts<s.end_s"""


def segments_with_boards(spark, sf):
    from lecturelab.operators.intervals import boards_in
    segs = T.segments(spark, sf)
    found = boards_in(T.boards(spark, sf).select("lecture_id", "bid", "key_ts"),
                      segs.select("lecture_id", "sid", F.col("start_s").alias("span_start"), F.col("end_s").alias("span_end")))
    ids = found.groupBy("lecture_id", "sid").agg(F.sort_array(F.collect_list("bid")).alias("board_ids"))
    return segs.join(ids, ["lecture_id", "sid"], "left").withColumn(
        "board_ids", F.coalesce("board_ids", F.array().cast("array<int>")))


@query("segment_board_text", sql("segments boards", """select lecture_id, sid, string_agg(latex, chr(10)||chr(10) order by bid) as board_text
 from sb where coalesce(latex,'')<>'' group by 1,2""", sb=SEG_BOARDS))
def _board_text(spark, sf):
    return R.segment_board_text(segments_with_boards(spark, sf), T.boards(spark, sf))


# one step per utterance: (first position of the window, words in it); a full window is emitted
CHUNKS = dict(
    su="""select lecture_id, uid//12 as sid, uid%12 as pos, start_s, text, words, sum(words) over (partition by lecture_id, uid//12 order by uid) as cum from speech""",
    fold="""select lecture_id, sid, pos, 0 as lo, words>=220 as full_, words as acc from su where pos=0
 union all
 select n.lecture_id, n.sid, n.pos, x.lo2, x.w2+n.words>=220, x.w2+n.words from (
  select f.lecture_id, f.sid, f.pos,
   case when f.full_ then (select max(s.pos) from su s where s.lecture_id=f.lecture_id and s.sid=f.sid and s.pos between f.lo and f.pos
     and (s.pos=f.lo or c.cum-s.cum+s.words>=40)) else f.lo end as lo2,
   case when f.full_ then (select c.cum-s.cum+s.words from su s where s.lecture_id=f.lecture_id and s.sid=f.sid and s.pos between f.lo and f.pos
     and (s.pos=f.lo or c.cum-s.cum+s.words>=40) order by s.pos desc limit 1) else f.acc end as w2
  from fold f join su c on c.lecture_id=f.lecture_id and c.sid=f.sid and c.pos=f.pos) x
  join su n on n.lecture_id=x.lecture_id and n.sid=x.sid and n.pos=x.pos+1""",
    ends="""select lecture_id, sid, lo, pos as hi from fold where full_
 union all
 select f.lecture_id, f.sid, case when f.full_ then (select max(s.pos) from su s where s.lecture_id=f.lecture_id and s.sid=f.sid and s.pos between f.lo and f.pos
     and (s.pos=f.lo or f.cumw-s.cum+s.words>=40)) else f.lo end, f.pos
 from (select fold.*, su.cum as cumw, row_number() over (partition by fold.lecture_id, fold.sid order by fold.pos desc) as last_ from fold join su using (lecture_id, sid, pos)) f where last_=1""",
    pieces="""select e.lecture_id, e.sid, e.lo, e.hi, min(u.start_s) filter (u.pos=e.lo) as start_s, string_agg(u.text,' ' order by u.pos) as text,
 row_number() over (partition by e.lecture_id order by e.sid, e.hi, e.lo)-1 as cid
 from (select *, row_number() over () as k from ends) e join su u on u.lecture_id=e.lecture_id and u.sid=e.sid and u.pos between e.lo and e.hi group by e.lecture_id, e.sid, e.lo, e.hi, e.k""",
)


@query("build_chunks", sql("speech segments boards", f"""select p.lecture_id, cast(p.cid as int) as cid, cast(p.sid as int) as sid, round(p.start_s,3) as start_s,
 case when s.title='' then 'Фрагмент '||{tc('s.start_s')} else s.title end as title, md5(p.text) as text_md5, p.hi-p.lo+1 as n_utterances
 from pieces p join segments s on s.lecture_id=p.lecture_id and s.sid=p.sid""", recursive=True, **CHUNKS))
def _chunks(spark, sf):
    out = R.build_chunks(T.segments(spark, sf), T.speech(spark, sf))
    return out.select(
        "lecture_id", "cid", "sid", rounded("start_s", 3).alias("start_s"), "title", F.md5("text").alias("text_md5"), "n_utterances")


@query("transcript_filter", sql("speech", """select lecture_id, uid, cast(row_number() over (partition by lecture_id order by uid) as int) as pos
 from speech where contains(lower(text), 'the') qualify pos<=1500"""))
def _filter(spark, sf):
    return R.transcript_filter(T.speech(spark, sf), "The").select("lecture_id", "uid", "pos")
