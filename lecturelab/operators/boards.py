"""Board states from ink masks.

Masks come bit-packed, `(lecture_id, frame_idx, ts, n_px, words array<bigint>)`, or as
sparse pixels `(lecture_id, frame_idx, y, x)`. `frame_idx` is dense.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lecturelab.functions.timecode import round_even
from lecturelab.operators.intervals import match_marks
from lecturelab.operators.ordered import block_of, dense_index, running, shifted
from lecturelab.params import BoardParams

MASK_BLOCK = 1024  # frames per block: masks are wide rows


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def ink_ratio(masks: DataFrame) -> DataFrame:
    return masks.select("lecture_id", "frame_idx", (_ones(F.col("words")) / F.col("n_px")).alias("ink_ratio"))


def ink_delta(masks: DataFrame, block: int = MASK_BLOCK) -> DataFrame:
    """Shares of pixels added and removed since the frame before; no row for the first frame."""
    pairs = shifted(masks, ["lecture_id"], "frame_idx", {"_prev": ("words", -1)}, block).where(F.col("_prev").isNotNull())
    added = _ones(F.zip_with("words", "_prev", lambda c, p: c.bitwiseAND(F.bitwise_not(p)))) / F.col("n_px")
    removed = _ones(F.zip_with("words", "_prev", lambda c, p: p.bitwiseAND(F.bitwise_not(c)))) / F.col("n_px")
    out = pairs.select(
        "lecture_id", "frame_idx", added.alias("added"), removed.alias("removed"),
        (_ones(F.col("words")) / F.col("n_px")).alias("coverage"))
    return out.withColumns({"net": F.col("added") - F.col("removed"), "churn": F.col("added") + F.col("removed")})


def dilate(px: DataFrame, height: int, width: int, iterations: int = 1) -> DataFrame:
    """Every inked pixel also inks its neighbours up to `iterations` away, inside the frame."""
    if iterations <= 0:
        return px
    reach = F.sequence(F.lit(-iterations), F.lit(iterations))
    grown = px.select("lecture_id", "frame_idx", "y", "x", F.explode(reach).alias("dy")).select(
        "lecture_id", "frame_idx", (F.col("y") + F.col("dy")).alias("y"), "x", F.explode(reach).alias("dx")
    ).select("lecture_id", "frame_idx", "y", (F.col("x") + F.col("dx")).alias("x"))
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    return grown.where(inside).distinct()


def sparse_delta(px: DataFrame, frames: DataFrame, n_px: int) -> DataFrame:
    """`added`, `removed` from sparse pixels: a pixel shows up as current in its frame and as previous in the next."""
    seen = px.select(
        "lecture_id", "y", "x", F.inline(F.array(
            F.struct(F.col("frame_idx").alias("frame_idx"), F.lit(1).alias("cur"), F.lit(0).alias("old")),
            F.struct((F.col("frame_idx") + 1).alias("frame_idx"), F.lit(0).alias("cur"), F.lit(1).alias("old")))))
    flags = seen.groupBy("lecture_id", "frame_idx", "y", "x").agg(F.max("cur").alias("cur"), F.max("old").alias("old"))
    per = flags.groupBy("lecture_id", "frame_idx").agg(
        (F.sum(F.when(F.col("old") == 0, 1).otherwise(0)) / n_px).alias("added"),
        (F.sum(F.when(F.col("cur") == 0, 1).otherwise(0)) / n_px).alias("removed"))
    later = frames.where(F.col("frame_idx") > 0).select("lecture_id", "frame_idx")
    return later.join(per, ["lecture_id", "frame_idx"], "left").fillna(0.0, ["added", "removed"])


def volatility(masks: DataFrame, bits: int = 64, block: int = MASK_BLOCK) -> DataFrame:
    """`lecture_id, pixel, changes, volatility` of every pixel that ever changed.

    Only changed words are unpacked; the share is over the frame pairs of the recording.
    """
    pairs = shifted(masks, ["lecture_id"], "frame_idx", {"_prev": ("words", -1)}, block).where(F.col("_prev").isNotNull())
    turned = pairs.select("lecture_id", F.posexplode(F.zip_with("words", "_prev", lambda c, p: c.bitwiseXOR(p))).alias("pos", "word"))
    turned = turned.where(F.col("word") != 0).select(
        "lecture_id", "pos", "word", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")
    ).where(F.expr("shiftrightunsigned(word, bit) & 1") == 1)
    counts = turned.groupBy("lecture_id", (F.col("pos") * bits + F.col("bit")).alias("pixel")).agg(F.count(F.lit(1)).alias("changes"))
    pair_count = masks.groupBy("lecture_id").agg((F.count(F.lit(1)) - 1).alias("pairs"))
    return counts.join(pair_count, "lecture_id").select(
        "lecture_id", "pixel", "changes", (F.col("changes") / F.col("pairs")).alias("volatility"))


def unstable_pixels(vol: DataFrame, dims: DataFrame, quantile: float = 0.985) -> DataFrame:
    """Pixels outside the content mask: volatility above the recording's quantile (at least 1e-6).

    The quantile runs over all `n_px` pixels; the never-changing ones enter as one counted
    value, so no pixel grid is built. `content_mask` blurs the map before and opens the mask after.
    """
    hist = vol.groupBy("lecture_id", "volatility").agg(F.count(F.lit(1)).alias("px"))
    moved = hist.groupBy("lecture_id").agg(F.sum("px").alias("moved"))
    still = moved.join(dims, "lecture_id").select(
        "lecture_id", F.lit(0.0).alias("volatility"), (F.col("n_px") - F.col("moved")).alias("px")).where("px > 0")
    limit = hist.unionByName(still).groupBy("lecture_id").agg(
        F.greatest(F.percentile("volatility", F.lit(quantile), F.col("px")), F.lit(1e-6)).alias("limit"))
    return vol.join(limit, "lecture_id").where(F.col("volatility") > F.col("limit")).select("lecture_id", "pixel", "volatility", "limit")


def smooth_volatility(vol: DataFrame, height: int, width: int, size: int = 9) -> DataFrame:
    """The map after a Gaussian blur of `size` by `size`, lines mirrored about the outermost pixel.

    One axis after the other; only pixels that changed, and those they reach, have rows. The kernel's
    width follows from its size, `0.3 * (size / 2 - 1.5) + 0.8`; an even size counts as the next odd
    one, and 1 leaves the map as it is. Both sides of a frame must be longer than half the kernel.
    """
    r = size // 2
    if min(height, width) <= r:
        raise ValueError(f"a frame of {height} x {width} is too small for a blur of {size}")
    if r == 0:
        return vol.select("lecture_id", "pixel", "volatility")
    cells = vol.select("lecture_id", *_yx(width), F.col("volatility").alias("v"))
    cells = _blurred(_blurred(cells, "y", "x", height, r), "x", "y", width, r)
    return cells.select("lecture_id", (F.col("y") * width + F.col("x")).alias("pixel"), F.round("v", 9).alias("volatility")).where("volatility > 0")


def _yx(width: int) -> list[Column]:
    return [F.floor(F.col("pixel") / width).cast("int").alias("y"), (F.col("pixel") % width).cast("int").alias("x")]


def _blurred(cells: DataFrame, axis: str, other: str, length: int, r: int) -> DataFrame:
    """Every pixel, and its mirror images beyond the edges, adds to the pixels at most `r` away along `axis`."""
    sigma = 0.3 * (r - 1) + 0.8
    bell = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    kernel = F.array(*[F.lit(b / sum(bell)) for b in bell])
    images = F.array_distinct(F.array(F.col(axis), -F.col(axis), 2 * (length - 1) - F.col(axis)))
    seen = cells.select("lecture_id", other, "v", F.explode(images).alias("p")).where(F.col("p").between(-r, length - 1 + r))
    to = F.sequence(F.greatest(F.col("p") - r, F.lit(0)), F.least(F.col("p") + r, F.lit(length - 1)))
    spread = seen.select("lecture_id", other, "v", "p", F.explode(to).alias(axis))
    return spread.groupBy("lecture_id", axis, other).agg(F.sum(F.col("v") * F.get(kernel, F.col(axis) - F.col("p") + r)).alias("v"))


def open_mask(unstable: DataFrame, height: int, width: int, size: int = 7) -> DataFrame:
    """`lecture_id, pixel` outside the mask once specks of it narrower than `size` are gone.

    Opening what is kept is closing what is not: grown by `size // 2`, then only pixels whose whole
    square is grown stay. A square is counted line by line, and ends at the edge of the frame.
    """
    r = size // 2
    cells = unstable.select("lecture_id", F.lit(0).alias("frame_idx"), *_yx(width))
    grown = dilate(cells, height, width, r).drop("frame_idx")
    for axis, other, length in (("y", "x", height), ("x", "y", width)):
        line = Window.partitionBy("lecture_id", other).orderBy(axis).rangeBetween(-r, r)
        full = F.least(F.col(axis) + r, F.lit(length - 1)) - F.greatest(F.col(axis) - r, F.lit(0)) + 1
        grown = grown.withColumn("_n", F.count(F.lit(1)).over(line)).where(F.col("_n") == full).drop("_n")
    return grown.select("lecture_id", (F.col("y") * width + F.col("x")).alias("pixel"))


def content_mask(
    masks: DataFrame, height: int, width: int, bits: int = 64, quantile: float = 0.985, smooth: int = 9, opening: int = 7
) -> DataFrame:
    """`lecture_id, pixel` of what moves: the blurred volatility above its quantile, the rest opened. No rows where nothing ever changed."""
    vol = smooth_volatility(volatility(masks, bits), height, width, smooth)
    dims = masks.select("lecture_id").distinct().withColumn("n_px", F.lit(height * width))
    return open_mask(unstable_pixels(vol, dims, quantile), height, width, opening)


def board_roi(
    px: DataFrame, height: int, width: int, unstable: DataFrame | None = None, p: BoardParams = BoardParams()
) -> DataFrame:
    """`lecture_id, x0, y0, x1, y1`: the box that holds `roi_keep` of the accumulated ink."""
    lectures = px.select("lecture_id").distinct()
    ink = px.groupBy("lecture_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    if unstable is not None:
        dead = unstable.select(
            "lecture_id", F.floor(F.col("pixel") / width).cast("int").alias("y"), (F.col("pixel") % width).cast("int").alias("x"))
        ink = ink.join(dead, ["lecture_id", "y", "x"], "left_anti")
    ys, xs = _bounds(ink, "y", height, p), _bounds(ink, "x", width, p)
    out = lectures.join(ys, "lecture_id", "left").join(xs, "lecture_id", "left")
    return out.select(
        "lecture_id", F.coalesce("x0", F.lit(0)).alias("x0"), F.coalesce("y0", F.lit(0)).alias("y0"),
        F.coalesce("x1", F.lit(width)).alias("x1"), F.coalesce("y1", F.lit(height)).alias("y1"))


def _bounds(ink: DataFrame, axis: str, limit: int, p: BoardParams) -> DataFrame:
    """First and last line of `axis` between the outer shares; at most `limit` rows per recording."""
    profile = ink.groupBy("lecture_id", axis).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lecture_id")
    share = F.sum("n").over(w.orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    cum = profile.withColumn("share", share)
    outer = (1.0 - p.roi_keep) / 2.0
    first = F.lit(0) if outer <= 0 else F.min(F.when(F.col("share") >= outer, F.col(axis)))
    last = F.coalesce(F.min(F.when(F.col("share") >= 1.0 - outer, F.col(axis))), F.lit(limit))
    edges = cum.groupBy("lecture_id").agg(
        F.greatest(first - p.roi_pad, F.lit(0)).alias("lo"), F.least(last + p.roi_pad + 1, F.lit(limit)).alias("hi"))
    narrow = F.col("hi") - F.col("lo") < 8
    return edges.select(
        "lecture_id", F.when(narrow, 0).otherwise(F.col("lo")).alias(f"{axis}0"),
        F.when(narrow, limit).otherwise(F.col("hi")).alias(f"{axis}1"))


def board_cuts(
    deltas: DataFrame, min_frames: int, tau_erase: Column | float, tau_jump: Column | float,
    keys: list[str] | None = None, block: int = 65_536,
) -> DataFrame:
    """Board states `keys, state, lo, hi` (frames `lo <= f < hi`) from frame deltas.

    `deltas` holds the frames from 1 on. A raw span shorter than `min_frames` joins the state
    before it; only the raw length counts, so two running sums do it.
    """
    keys = keys or ["lecture_id"]
    cut = (F.col("removed") > tau_erase) | (F.col("added") > tau_jump)
    first = deltas.groupBy(*keys).agg(F.lit(0).alias("frame_idx"), F.lit(False).alias("cut"))
    frames = deltas.select(*keys, "frame_idx", cut.alias("cut")).unionByName(first)
    spans = running(frames, keys, ["frame_idx"], block_of(F.col("frame_idx"), block),
                    {"raw": ("sum", F.col("cut").cast("long"))})
    raw = spans.groupBy(*keys, "raw").agg(F.min("frame_idx").alias("lo"), (F.max("frame_idx") + 1).alias("hi"))
    opens = (F.col("raw") == 0) | (F.col("hi") - F.col("lo") >= min_frames)
    states = running(raw, keys, ["raw"], block_of(F.col("raw"), block), {"state": ("sum", opens.cast("long"))})
    return states.groupBy(*keys, (F.col("state") - 1).cast("int").alias("state")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def frame_states(states: DataFrame) -> DataFrame:
    """`lecture_id, state, lo, frame_idx` of every frame of a state."""
    return states.select("lecture_id", "state", "lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("frame_idx"))


def board_keyframes(states: DataFrame, frames: DataFrame, lectures: DataFrame, p: BoardParams = BoardParams()) -> DataFrame:
    """Boards `lecture_id, bid, start_s, end_s, key_ts, ink_ratio`.

    The key frame is the fullest one, the later of equals. A state ends where the next one
    starts, dropped or not; states emptier than `min_ink_ratio` are dropped.
    `frames`: `lecture_id, frame_idx, ts, coverage`.
    """
    rows = frame_states(states).join(frames, ["lecture_id", "frame_idx"])
    local = F.col("frame_idx") - F.col("lo")
    per = rows.groupBy("lecture_id", "state").agg(
        F.max_by(F.struct("ts", "coverage"), F.struct(F.col("coverage") + 1e-9 * local, F.col("frame_idx"))).alias("best"),
        F.min("ts").alias("start_s"))
    after = shifted(per, ["lecture_id"], "state", {"_next": ("start_s", 1)})
    ended = after.join(lectures.select("lecture_id", "duration"), "lecture_id", "left").select(
        "lecture_id", "state", "start_s",
        F.greatest(F.coalesce("_next", "duration"), F.col("start_s")).alias("end_s"),
        F.col("best.ts").alias("key_ts"), F.col("best.coverage").alias("coverage"))
    kept = ended.where(F.col("coverage") >= p.min_ink_ratio)
    numbered = dense_index(kept, ["lecture_id"], ["state"], block_of(F.col("state")), "bid")
    return numbered.select(
        "lecture_id", "bid", "start_s", "end_s", "key_ts", round_even(F.col("coverage"), 5).alias("ink_ratio"))


# The calibration grid.
ERASE_GRID = (0.004, 0.007, 0.010, 0.015, 0.022)
JUMP_GRID = (0.04, 0.06, 0.09)


def calibrate(
    deltas: DataFrame, frames: DataFrame, truth: DataFrame, tolerance: float = 6.0, min_frames: int = 8,
    erase: tuple[float, ...] = ERASE_GRID, jump: tuple[float, ...] = JUMP_GRID,
) -> DataFrame:
    """Per recording and threshold pair: number of states, precision, recall, f1.

    `truth`: `lecture_id, t`. The fixed grid is unfolded from a literal array, row by row.
    """
    grid = F.array(*[
        F.struct(F.lit(i).alias("trial"), F.lit(e).alias("tau_erase"), F.lit(j).alias("tau_jump"))
        for i, (e, j) in enumerate((e, j) for e in erase for j in jump)])
    keys = ["lecture_id", "trial", "tau_erase", "tau_jump"]
    tried = deltas.select("lecture_id", "frame_idx", "added", "removed", F.inline(grid))
    states = board_cuts(tried, min_frames, F.col("tau_erase"), F.col("tau_jump"), keys)
    starts = states.join(frames.select("lecture_id", F.col("frame_idx").alias("lo"), F.col("ts").alias("t")), ["lecture_id", "lo"])
    return match_marks(truth.select("lecture_id", "t", F.inline(grid)), starts, tolerance, keys)


def best_thresholds(trials: DataFrame) -> DataFrame:
    """The trial with the highest f1 of each recording; the first of equals."""
    best = trials.groupBy("lecture_id").agg(
        F.max_by(F.struct("trial", "tau_erase", "tau_jump", "n_pred", "f1"), F.struct("f1", -F.col("trial"))).alias("b"))
    return best.select("lecture_id", "b.*")


def board_filter(boards: DataFrame, keep_confidence: float = 0.35) -> DataFrame:
    """Boards that were read, or are confident enough."""
    read = F.coalesce("latex", F.lit("")) != ""
    return boards.where(read | (F.coalesce("confidence", F.lit(0.0)) >= keep_confidence))


def board_read_report(boards: DataFrame, keep_confidence: float = 0.35) -> DataFrame:
    """Per recording: boards read, kept, and without a frame file (`frame_found` is false)."""
    read = F.coalesce("latex", F.lit("")) != ""
    kept = read | (F.coalesce("confidence", F.lit(0.0)) >= keep_confidence)
    return boards.groupBy("lecture_id").agg(
        F.count_if(read).alias("read"), F.count_if(kept).alias("kept"), F.count_if(~F.col("frame_found")).alias("frames_missing"))


def vision_report(frames: DataFrame, boards: DataFrame, roi: DataFrame, unstable: DataFrame) -> DataFrame:
    """Per recording: sampled frames, box, number of boards, share of stable pixels."""
    sampled = frames.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("sampled_frames"), F.max("n_px").alias("n_px"))
    states = boards.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("states"))
    noisy = unstable.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("noisy"))
    box = roi.select("lecture_id", F.concat_ws(",", "x0", "y0", "x1", "y1").alias("roi"))
    out = sampled.join(states, "lecture_id", "left").join(noisy, "lecture_id", "left").join(box, "lecture_id", "left")
    return out.select(
        "lecture_id", "sampled_frames", "roi", F.coalesce("states", F.lit(0)).alias("states"),
        round_even(1 - F.coalesce("noisy", F.lit(0)) / F.col("n_px"), 4).alias("stable_fraction"))
