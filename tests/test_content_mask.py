"""Blurred volatility and opened masks against plain loops over the whole grid."""

import math
import random

import pytest

from lecturelab.operators import boards


def mirrored(k, n):
    return -k if k < 0 else 2 * (n - 1) - k if k >= n else k


def by_loop(frames, h, w, quantile, smooth, opening):
    r, o = smooth // 2, opening // 2
    v = [[sum(a[y][x] != b[y][x] for a, b in zip(frames, frames[1:])) / (len(frames) - 1) for x in range(w)] for y in range(h)]
    s = 0.3 * (r - 1) + 0.8
    g = [math.exp(-0.5 * (d / s) ** 2) for d in range(-r, r + 1)] if r else [1.0]
    g = [x / sum(g) for x in g]
    v = [[round(sum(g[a + r] * g[b + r] * v[mirrored(y + a, h)][mirrored(x + b, w)] for a in range(-r, r + 1) for b in range(-r, r + 1)), 9)
          for x in range(w)] for y in range(h)]
    flat = sorted(c for line in v for c in line)
    at = quantile * (len(flat) - 1)
    low = flat[math.floor(at)] + (flat[math.ceil(at)] - flat[math.floor(at)]) * (at - math.floor(at))
    keep = [[c <= max(low, 1e-6) for c in line] for line in v]
    near = lambda m, y, x: [m[b][a] for b in range(max(0, y - o), min(h, y + o + 1)) for a in range(max(0, x - o), min(w, x + o + 1))]
    keep = [[all(near(keep, y, x)) for x in range(w)] for y in range(h)]
    return {y * w + x for y in range(h) for x in range(w) if not any(near(keep, y, x))}


def packed(spark, recordings, w):
    rows = []
    for name, frames in recordings.items():
        for k, f in enumerate(frames):
            bits = [c for line in f for c in line]
            words = [sum(b << j for j, b in enumerate(bits[i: i + 60])) for i in range(0, len(bits), 60)]
            rows.append((name, k, len(bits), words))
    return spark.createDataFrame(rows, "lecture_id string, frame_idx int, n_px int, words array<bigint>").repartition(3)


@pytest.mark.parametrize("h,w,smooth,opening", [(18, 25, 9, 7), (12, 9, 5, 3), (5, 30, 9, 7), (8, 8, 1, 1)])
def test_content_mask_equals_a_loop(spark, h, w, smooth, opening):
    rng = random.Random(h * w)
    still = [[[int((y * 3 + x) % 5 == 0) for x in range(w)] for y in range(h)] for _ in range(6)]
    moving = [[[c ^ int(x > w // 2 and y < h // 2 and rng.random() < 0.5) ^ int(rng.random() < 0.02) for x, c in enumerate(line)] for y, line in enumerate(f)] for f in still]
    corner = [[[c ^ int(y + x < 4 and k % 2) for x, c in enumerate(line)] for y, line in enumerate(f)] for k, f in enumerate(still)]
    recordings = {"still": still, "moving": moving, "corner": corner, "one": still[:1]}
    got = {}
    for r in boards.content_mask(packed(spark, recordings, w), h, w, 60, 0.9, smooth, opening).collect():
        got.setdefault(r.lecture_id, []).append(r.pixel)
    want = {k: by_loop(recordings[k], h, w, 0.9, smooth, opening) for k in ("still", "moving", "corner")}
    assert want["moving"] and not want["still"] and "one" not in got
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_a_frame_smaller_than_the_kernel_is_refused(spark):
    with pytest.raises(ValueError, match="too small"):
        boards.smooth_volatility(spark.createDataFrame([], "lecture_id string, pixel long, volatility double"), 4, 30)
