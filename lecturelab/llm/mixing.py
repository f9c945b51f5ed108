"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

The documents of a source, in a seeded order, are one line of words, cut into blocks of `block_words`. Targets
are apportioned in blocks by highest quotients target / (2 * seats + 1); the awards up to each shard's end give that
shard's integer quotas. A source's blocks are dealt from a seeded block on, around its line and again where its quota
exceeds its blocks, so documents stay whole except at the ends, and no block comes more than `max_repeats` times.

The driver sees one row per source (as many rows as the mixture has weights). A source may hold most rows: places on
its line come from sums of hash buckets, never from a window over the source. A document's place among the others of
its source depends on their hashes only, not on how many rows or buckets there are.

Edge cases: a null text has no words and is never taken; a null source is a source of its own, last in order; a null id
is hashed like any other; repeated rows are separate documents; sources without words have target 0; an empty table
gives an empty result. Only the id, source and text columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lecturelab.llm.common import materialise, n_words


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (3, 1, 2)
    share_percent: int = 150
    max_repeats: int = 2
    block_words: int = 8
    shards: int = 8
    seed: int = 42


def targets(sizes: Sequence[int], params: MixParams = MixParams()) -> list[float]:
    """Words due to each source, in the given order: weighted shares of the whole, none above its limit."""
    weights = [params.weights[i % len(params.weights)] for i in range(len(sizes))]
    left, weight = params.share_percent * sum(sizes) / 100, sum(weights)
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    for n, i in enumerate(order):
        limit = params.max_repeats * sizes[i]
        if weights[i] * left / weight <= limit:
            for j in order[n:]:
                out[j] = weights[j] * left / weight
            break
        out[i] = float(limit)
        left, weight = left - limit, weight - weights[i]
    return out


def apportion(due: Sequence[float], house: int, limits: Sequence[int]) -> list[int]:
    """Seats by highest quotients due / (2 * seats + 1); ties go to the earlier source; `limits` bound the seats."""
    total = sum(due)
    if total <= 0 or house <= 0:
        return [0] * len(due)
    seats = [min(int(d * house / total + 0.5), m) for d, m in zip(due, limits, strict=True)]
    # rounding at the mean quotient is off by a few seats: give or take back single ones
    surplus = sum(seats) - house
    if surplus < 0:
        heap = [(-d / (2 * s + 1), i) for i, (d, s) in enumerate(zip(due, seats, strict=True))]
        heapq.heapify(heap)
        while surplus < 0 and heap:
            _, i = heapq.heappop(heap)
            if seats[i] < limits[i]:
                seats[i] += 1
                surplus += 1
                heapq.heappush(heap, (-due[i] / (2 * seats[i] + 1), i))
    else:
        heap = [(due[i] / (2 * s - 1), -i) for i, s in enumerate(seats) if s]
        heapq.heapify(heap)
        while surplus > 0:
            _, back = heapq.heappop(heap)
            seats[-back] -= 1
            surplus -= 1
            if seats[-back]:
                heapq.heappush(heap, (due[-back] / (2 * seats[-back] - 1), back))
    return seats


def shard_quotas(due: Sequence[float], blocks: Sequence[int], params: MixParams = MixParams()) -> list[list[int]]:
    """Blocks of each source in each shard: what the awards add from one shard's end to the next."""
    house = round(sum(due) / params.block_words)
    limits = [params.max_repeats * b for b in blocks]
    ends = [apportion(due, house * (k + 1) // params.shards, limits) for k in range(params.shards)]
    return [[b - a for a, b in zip(before, after, strict=True)] for before, after in zip([[0] * len(due), *ends], ends, strict=False)]


def block_runs(quotas: Sequence[int], blocks: int, first: int) -> list[tuple[int, int, int, int]]:
    """(shard, pass, from block, to block) for one source: its quotas in order, from block `first` around the line."""
    out, at = [], 0
    for shard, quota in enumerate(quotas):
        end = at + quota
        while at < end:
            place = (first + at) % blocks
            stop = min(end - at, blocks - place, blocks - at % blocks)
            out.append((shard, at // blocks, place, place + stop))
            at += stop
    return out


_PLAN = "source string, source_size long, target double, runs array<struct<shard:int,pass:int,lo:long,hi:long>>"


def plan(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per source: its size, target, and the word ranges of its line that each shard takes."""
    spark = sizes.sparkSession
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.xxhash64(F.lit(params.seed), F.col("source")).alias("_h"))
    found = sorted(per_source.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    total = [r["source_size"] for r in found]
    due = targets(total, params)
    blocks = [-(-s // params.block_words) for s in total]
    quotas = shard_quotas(due, blocks, params)
    rows = []
    for i, r in enumerate(found):
        own = [q[i] for q in quotas]
        runs = block_runs(own, blocks[i], r["_h"] % blocks[i]) if blocks[i] else []
        rows.append((r["source"], total[i], due[i], [(s, p, lo * params.block_words, hi * params.block_words) for s, p, lo, hi in runs]))
    return spark.createDataFrame(rows, _PLAN)


def placed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", params: MixParams = MixParams()) -> DataFrame:
    """One row per document: key, `source`, `size`, `start` on its source's line, and its source's plan."""
    sizes = materialise(docs.select(F.col(key), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    # the order is that of the hash read as unsigned; its leading bits are the bucket, so how many there are changes no place.
    # about as many buckets as a bucket has documents: neither a bucket nor a source's list of buckets gets long
    bits = max(1, (sizes.count().bit_length() + 1) // 2)
    h = F.xxhash64(F.lit(params.seed), F.col(key), F.col("size"))
    dealt = sizes.withColumns({"_h": h, "_bucket": F.shiftrightunsigned(h, 64 - bits)})
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_n")).select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    lined = local.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    plans = plan(sizes, params).withColumnRenamed("source", "_p")
    return lined.join(plans, F.col("source").eqNullSafe(F.col("_p"))).select(
        key, "source", "size", (F.col("_offset") + F.col("_local")).alias("start"), "source_size", "target", "runs")


def _overlap(run: Column) -> Column:
    end = F.col("start") + F.col("size")
    return F.greatest(F.least(run["hi"], end) - F.greatest(run["lo"], F.col("start")), F.lit(0).cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", params: MixParams = MixParams()) -> DataFrame:
    """key, `size`, `source_size`, `target`, `taken` (words the mix takes, repeats counted)."""
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda a, run: a + _overlap(run))
    return placed(docs, key, source, text, params).select(key, "size", "source_size", "target", taken.alias("taken"))


def pieces(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", params: MixParams = MixParams()) -> DataFrame:
    """What the shards take: key, `shard`, `pass`, `from_word` (0-based in the document), `n_words`."""
    used = F.filter("runs", lambda run: _overlap(run) > 0)
    cut = placed(docs, key, source, text, params).select(key, "start", "size", F.explode(used).alias("run"))
    return cut.select(
        key, F.col("run.shard").alias("shard"), F.col("run.pass").alias("pass"),
        F.greatest(F.col("run.lo") - F.col("start"), F.lit(0).cast("long")).alias("from_word"), _overlap(F.col("run")).alias("n_words"))
