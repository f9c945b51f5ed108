"""Board tracking over the sample masks, and the boards of the document recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lecturelab.operators import boards as B
from lecturelab.params import BoardParams
from lecturelab.plans.oracle import rounded, sql
from lecturelab.plans.registry import query
from lecturelab.sources import tables as T

SIDE, AREA = T.MASK_SIDE, T.MASK_SIDE**2

CUR = dict(
    both_="""select lecture_id, frame_idx, y, x, max(c) as cur, max(o) as old from (select lecture_id, frame_idx, y, x, 1 as c, 0 as o from px
 union all select lecture_id, frame_idx+1, y, x, 0, 1 from px) group by 1,2,3,4""",
    delta="""select f.lecture_id, f.frame_idx, coalesce(sum(case when old=0 then 1 else 0 end),0)/64 as added,
 coalesce(sum(case when cur=0 then 1 else 0 end),0)/64 as removed, coalesce(sum(cur),0)/64 as coverage
 from frames f left join both_ using (lecture_id, frame_idx) where f.frame_idx>0 group by 1,2""",
    cov="select f.lecture_id, f.frame_idx, count(p.y)/64 as coverage from frames f left join px p using (lecture_id, frame_idx) group by 1,2",
    wide="""select distinct lecture_id, frame_idx, y+dy as y, x+dx as x from px, range(-1,2) a(dy), range(-1,2) b(dx) where y+dy between 0 and 7 and x+dx between 0 and 7""",
    wboth="""select lecture_id, frame_idx, y, x, max(c) as cur, max(o) as old from (select lecture_id, frame_idx, y, x, 1 as c, 0 as o from wide
 union all select lecture_id, frame_idx+1, y, x, 0, 1 from wide) group by 1,2,3,4""",
    wdelta="""select f.lecture_id, f.frame_idx, coalesce(sum(case when old=0 then 1 else 0 end),0)/64 as added,
 coalesce(sum(case when cur=0 then 1 else 0 end),0)/64 as removed
 from frames f left join wboth using (lecture_id, frame_idx) where f.frame_idx>0 group by 1,2""",
)


def _cuts(erase="0.010", jump="0.060", src="(select lecture_id, '' as tr, frame_idx, added, removed, 0.010 as te, 0.060 as tj from wdelta)"):
    return dict(
        flagged=f"""select lecture_id, tr, frame_idx, cast(removed>te or added>tj as int) as cut from {src} d
 union all select lecture_id, tr, 0, 0 from {src} d group by 1,2""",
        rawspan="select *, sum(cut) over (partition by lecture_id, tr order by frame_idx) as raw from flagged",
        rawlen="select lecture_id, tr, raw, min(frame_idx) as lo, max(frame_idx)+1 as hi from rawspan group by 1,2,3",
        joined="select *, sum(case when raw=0 or hi-lo>=2 then 1 else 0 end) over (partition by lecture_id, tr order by raw)-1 as state from rawlen",
        states="select lecture_id, tr, cast(state as int) as state, min(lo) as lo, max(hi) as hi from joined group by 1,2,3",
    )


PARAMS = BoardParams(min_state_seconds=2.0)


def wide_delta(spark, sf):
    px = B.dilate(T.mask_px(spark, sf), SIDE, SIDE, PARAMS.dilate_iters)
    return B.sparse_delta(px, T.masks(spark, sf), AREA)


def states(spark, sf):
    return B.board_cuts(wide_delta(spark, sf), PARAMS.min_state_frames, PARAMS.tau_erase, PARAMS.tau_jump)


def coverage(spark, sf):
    m = T.masks(spark, sf)
    return m.select("lecture_id", "frame_idx", "ts").join(
        B.ink_ratio(m).withColumnRenamed("ink_ratio", "coverage"), ["lecture_id", "frame_idx"])


def durations(spark, sf):
    return T.masks(spark, sf).groupBy("lecture_id").agg((F.max("ts") + 1.0).alias("duration"))


@query("ink_ratio", sql("frames px", "select lecture_id, frame_idx, round(coverage,6) as ink_ratio from cov", **CUR))
def _ratio(spark, sf):
    return B.ink_ratio(T.masks(spark, sf)).withColumn("ink_ratio", rounded("ink_ratio", 6))


@query("ink_delta", sql("frames px", """select lecture_id, frame_idx, round(added,6) as added, round(removed,6) as removed, round(coverage,6) as coverage,
 round(added-removed,6) as net, round(added+removed,6) as churn from delta""", **CUR))
def _delta(spark, sf):
    out = B.ink_delta(T.masks(spark, sf))
    return out.select("lecture_id", "frame_idx", *[rounded(c, 6).alias(c) for c in ("added", "removed", "coverage", "net", "churn")])


@query("dilate_mask", sql("frames px", "select * from wide", wide=CUR["wide"]))
def _dilate(spark, sf):
    return B.dilate(T.mask_px(spark, sf), SIDE, SIDE)


@query("sparse_delta", sql("frames px", "select lecture_id, frame_idx, round(added,6) as added, round(removed,6) as removed from wdelta", **CUR))
def _wdelta(spark, sf):
    return wide_delta(spark, sf).select("lecture_id", "frame_idx", rounded("added", 6).alias("added"), rounded("removed", 6).alias("removed"))


VOL = dict(
    CUR,
    vol="""select b.lecture_id, y*8+x as pixel, count(*) as changes, count(*)/max(n.n-1) as v from both_ b join
 (select lecture_id, count(*) as n from frames group by 1) n on n.lecture_id=b.lecture_id where cur<>old and frame_idx between 1 and n.n-1 group by 1,2""",
    allv="select g.lecture_id, g.pixel, coalesce(v.v,0) as v from (select distinct f.lecture_id, r.pixel from frames f, range(0,64) r(pixel)) g left join vol v using (lecture_id, pixel)",
    noisy="select a.lecture_id, a.pixel from allv a join (select lecture_id, greatest(quantile_cont(v, 0.9), 1e-6) as q from allv group by 1) using (lecture_id) where v>q",
)
QUANTILE = 0.9


def _unstable(spark, sf):
    m = T.masks(spark, sf)
    return B.unstable_pixels(B.volatility(m, 32), m.groupBy("lecture_id").agg(F.max("n_px").alias("n_px")), QUANTILE)


@query("volatility_map", sql("frames px", "select lecture_id, cast(pixel as int) as pixel, changes, round(v,6) as volatility from vol", **VOL))
def _vol(spark, sf):
    return B.volatility(T.masks(spark, sf), 32).withColumn("volatility", rounded("volatility", 6))


@query("content_mask", sql("frames px", "select lecture_id, cast(pixel as int) as pixel from noisy", **VOL))
def _content(spark, sf):
    return _unstable(spark, sf).select("lecture_id", "pixel")


SMOOTH, OPENING = 5, 3  # the sample frames are 8 by 8
SMOOTHED = dict(
    VOL,
    kern="select d, e/sum(e) over () as g from (select d, exp(-0.5*pow(d/1.1,2)) as e from range(-2,3) t(d))",
    grid="select lecture_id, pixel//8 as y, pixel%8 as x, v from allv",
    blur="""select o.lecture_id, o.y, o.x, round(sum(a.g*b.g*i.v),9) as v from grid o, kern a, kern b, grid i where i.lecture_id=o.lecture_id
 and i.y=case when o.y+a.d>7 then 14-o.y-a.d else abs(o.y+a.d) end and i.x=case when o.x+b.d>7 then 14-o.x-b.d else abs(o.x+b.d) end group by 1,2,3""",
    still="select b.lecture_id, y, x, v<=q as keep from blur b join (select lecture_id, greatest(quantile_cont(v,0.9),1e-6) as q from blur group by 1) using (lecture_id)",
    eroded="select o.lecture_id, o.y, o.x, bool_and(i.keep) as keep from still o join still i on i.lecture_id=o.lecture_id and abs(i.y-o.y)<=1 and abs(i.x-o.x)<=1 group by 1,2,3",
    opened="select o.lecture_id, o.y, o.x, bool_or(i.keep) as keep from eroded o join eroded i on i.lecture_id=o.lecture_id and abs(i.y-o.y)<=1 and abs(i.x-o.x)<=1 group by 1,2,3",
)


@query("smooth_content_mask", sql("frames px", "select lecture_id, cast(y*8+x as int) as pixel from opened where not keep", **SMOOTHED))
def _smooth(spark, sf):
    """The mask from the blurred map, opened."""
    return B.content_mask(T.masks(spark, sf), SIDE, SIDE, 32, QUANTILE, SMOOTH, OPENING)


def _axis(a, lim):
    return f"""select lecture_id, case when hi-lo<8 then 0 else lo end as {a}0, case when hi-lo<8 then {lim} else hi end as {a}1 from (
 select lecture_id, greatest(min({a}) filter (c>=0.15)-1,0) as lo, least(coalesce(min({a}) filter (c>=0.85),{lim})+1+1,{lim}) as hi from (
 select lecture_id, {a}, sum(n) over (partition by lecture_id order by {a})/sum(n) over (partition by lecture_id) as c from (
 select lecture_id, {a}, count(*) as n from goodpx group by 1,2)) group by 1)"""


ROI = dict(VOL, goodpx="select px.* from px anti join noisy n on n.lecture_id=px.lecture_id and n.pixel=px.y*8+px.x", ys=_axis("y", 8), xs=_axis("x", 8))
ROI_P = BoardParams(roi_keep=0.7, roi_pad=1)


@query("board_roi", sql("frames px", "select lecture_id, x0::int as x0, y0::int as y0, x1::int as x1, y1::int as y1 from ys join xs using (lecture_id)", **ROI))
def _roi(spark, sf):
    return B.board_roi(T.mask_px(spark, sf), SIDE, SIDE, _unstable(spark, sf), ROI_P)


@query("board_cuts", sql("frames px", "select lecture_id, state, lo, hi from states", **CUR, **_cuts()))
def _board_cuts(spark, sf):
    return states(spark, sf)


KEY = dict(
    members="select s.lecture_id, s.state, c.frame_idx, c.coverage, c.coverage+1e-9*(c.frame_idx-s.lo) as score from states s join cov c on c.lecture_id=s.lecture_id and c.frame_idx>=s.lo and c.frame_idx<s.hi",
    best="select lecture_id, state, min(frame_idx) as start_, arg_max(frame_idx, [score, frame_idx]) as key_ from members group by 1,2",
    timed="""select b.*, c.coverage, greatest(coalesce(lead(start_) over (partition by b.lecture_id order by state), n.n), start_) as end_ from best b
 join cov c on c.lecture_id=b.lecture_id and c.frame_idx=b.key_ join (select lecture_id, count(*) as n from frames group by 1) n on n.lecture_id=b.lecture_id""",
)


@query("board_keyframes", sql("frames px", """select lecture_id, cast(row_number() over (partition by lecture_id order by state)-1 as int) as bid, start_::double as start_s, end_::double as end_s,
 key_::double as key_ts, round_even(coverage*1e5,0)/1e5 as ink_ratio from timed where coverage>=0.002""", **CUR, **_cuts(), **KEY))
def keyframes(spark, sf):
    return B.board_keyframes(states(spark, sf), coverage(spark, sf), durations(spark, sf), PARAMS)


@query("vision_report", sql("frames px", """select f.lecture_id, f.n as sampled_frames, xs.x0||','||ys.y0||','||xs.x1||','||ys.y1 as roi, coalesce(k.c,0) as states,
 round_even((1-coalesce(u.c,0)/64)*1e4,0)/1e4 as stable_fraction from (select lecture_id, count(*) as n from frames group by 1) f
 left join (select lecture_id, count(*) as c from timed where coverage>=0.002 group by 1) k using (lecture_id)
 left join (select lecture_id, count(*) as c from noisy group by 1) u using (lecture_id) join ys using (lecture_id) join xs using (lecture_id)""",
    **ROI, **_cuts(), **KEY))
def _vision(spark, sf):
    unstable = _unstable(spark, sf)
    roi = B.board_roi(T.mask_px(spark, sf), SIDE, SIDE, unstable, ROI_P)
    return B.vision_report(T.masks(spark, sf).select("lecture_id", "n_px"), keyframes(spark, sf), roi, unstable)


GRID = "select (i*3+j)::int as tr, e as te, p as tj from (select i, [0.004,0.007,0.010,0.015,0.022][i+1] as e, j, [0.04,0.06,0.09][j+1] as p from range(0,5) a(i), range(0,3) b(j))"
CAL = dict(
    grid=GRID,
    **_cuts(src="(select lecture_id, tr, frame_idx, added, removed, te, tj from wdelta, grid)"),
    prd="select lecture_id, tr, lo::double as p, row_number() over (partition by lecture_id, tr order by lo) as j from states",
    tru="select lecture_id, frame_idx::double as t, row_number() over (partition by lecture_id order by frame_idx) as i from frames where embedding[1]>0.2",
    walk="""select t.lecture_id, g.tr, 0::bigint as i, []::bigint[] as used from tru t, grid g where i=1
 union all select w.lecture_id, w.tr, t.i, case when x.j is null then w.used else list_append(w.used, x.j) end from walk w join tru t on t.lecture_id=w.lecture_id and t.i=w.i+1
 left join lateral (select min(p.j) as j from prd p where p.lecture_id=w.lecture_id and p.tr=w.tr and abs(p.p-t.t)<=2 and not list_contains(w.used,p.j)) x on true""",
    hits="select lecture_id, tr, max(len(used)) as hits from walk group by 1,2",
    prf="""select a.lecture_id, a.tr, g.te, g.tj, a.n as n_pred, coalesce(t.n,0) as n_true, coalesce(h.hits,0)/a.n as p, case when t.n>0 then coalesce(h.hits,0)/t.n else 0 end as r
 from (select lecture_id, tr, count(*) as n from states group by 1,2) a join grid g using (tr) left join (select lecture_id, count(*) as n from tru group by 1) t on t.lecture_id=a.lecture_id
 left join hits h on h.lecture_id=a.lecture_id and h.tr=a.tr""",
    scored="select *, case when p+r>0 then 2*p*r/(p+r) else 0 end as f1 from prf",
)


def _trials(spark, sf):
    emb = T._frames(spark, sf).where(F.get("embedding", F.lit(0)) > 0.2)
    truth = emb.select("lecture_id", F.col("frame_idx").cast("double").alias("t"))
    return B.calibrate(wide_delta(spark, sf), T.masks(spark, sf).select("lecture_id", "frame_idx", "ts"), truth, 2.0, 2)


@query("calibrate_thresholds", sql("frames px", """select lecture_id, tr as trial, te::double as tau_erase, tj::double as tau_jump, n_pred, round(p,6) as precision, round(r,6) as recall, round(f1,6) as f1 from scored""",
    recursive=True, **CUR, **CAL))
def _calibrate(spark, sf):
    out = _trials(spark, sf)
    return out.select("lecture_id", "trial", "tau_erase", "tau_jump", "n_pred", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("best_thresholds", sql("frames px", """select lecture_id, tr as trial, te::double as tau_erase, tj::double as tau_jump, n_pred, round(f1,6) as f1 from scored
 qualify row_number() over (partition by lecture_id order by round(f1,9) desc, tr)=1""", recursive=True, **CUR, **CAL))
def _best(spark, sf):
    trials = _trials(spark, sf).withColumn("f1", rounded("f1", 9))
    return B.best_thresholds(trials).withColumn("f1", rounded("f1", 6))


@query("board_filter", sql("boards", "select lecture_id, bid from boards where coalesce(latex,'')<>'' or coalesce(confidence,0)>=0.35"))
def _filter(spark, sf):
    return B.board_filter(T.boards(spark, sf)).select("lecture_id", "bid")


@query("board_read_report", sql("boards", """select lecture_id, count(*) filter (coalesce(latex,'')<>'') as read, count(*) filter (coalesce(latex,'')<>'' or coalesce(confidence,0)>=0.35) as kept,
 count(*) filter (bid%4=3) as frames_missing from boards group by 1"""))
def _read_report(spark, sf):
    return B.board_read_report(T.boards(spark, sf).withColumn("frame_found", F.col("bid") % 4 != 3))
