"""Importance resampling towards a target distribution, with Arrow kernels.

A batch of texts is lower-cased (A-Z only), split at every run of ASCII that is neither digit nor lower-case letter,
flattened, and encoded as dictionary indices. Features are runs of 1 to `n` words: a longer run is a pair of its shorter
run's index and the index of the next word, found by shifting the indices by one; the distinct pairs of the batch
are hashed once each, by going on from the CRC of the shorter run. Gains are taken by bucket and reduced row by row.

What is gathered: a partition counts its features by bucket, so one row a bucket leaves it; the sums (`buckets` rows, a
parameter) give the gains, which go back to the tasks as one array. Scores are drawn as Gumbel noise from a hash
of the key, so reruns agree. Ranks come from one sort by range over slim rows, ties cut apart by the row's place, and the
partitions' sizes; no group of equal scores or repeated rows is in one task.

Edge cases: a null or empty text has no words, `n_features` 0 and weight 0; texts are taken whole (a batch is cut into
slices of about `SLICE` bytes, a longer text is one slice); a null key hashes as the empty text and comes last among
equal scores; repeated rows are scored alike and ranked each for itself; an empty target makes rare features
the better ones, by the formula; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lecturelab.llm.common import materialise

#: What lies between words: ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE = 1 << 23
_ROW_BITS = 33  # of monotonically_increasing_id


@dataclass(frozen=True)
class ResampleParams:
    n: int = 1
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The batch in pieces of about `SLICE` bytes, rows whole."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(int(np.searchsorted(sizes, before + SLICE, side="right")), start + 1)
        # copied, as casts and string kernels misread an array that starts inside another
        yield texts.take(pa.array(np.arange(start, stop)))
        start = stop


def features(texts: pa.Array, params: ResampleParams) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length of run: the rows that the runs are in, ascending, and their buckets; and the words of each row."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.split_pattern_regex(pc.ascii_lower(plain), pattern=BETWEEN)
    row = pc.list_parent_indices(parts).to_numpy()
    word = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(word), 0)
    row, word = row[full.to_numpy(zero_copy_only=False)], word.filter(full).dictionary_encode()
    index = word.indices.to_numpy().astype(np.int64)
    spelled = [w.encode() for w in word.dictionary.to_pylist()]
    crcs = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
    run, out = index, [(row, crcs[index] % params.buckets)]
    for length in range(2, params.n + 1):
        inside = row[: len(row) - length + 1] == row[length - 1:]
        pairs = run[: len(inside)] * max(len(spelled), 1) + index[length - 1:]
        distinct = pa.array(pairs).dictionary_encode()
        shorter, word_no = np.divmod(distinct.dictionary.to_numpy(), max(len(spelled), 1))
        longer = [zlib.crc32(b" " + spelled[w], crc) for w, crc in zip(word_no.tolist(), crcs[shorter].tolist(), strict=True)]
        run, crcs = distinct.indices.to_numpy().astype(np.int64), np.array(longer, np.int64)
        out.append((row[: len(inside)][inside], crcs[run[inside]] % params.buckets))
    return out, np.bincount(row, minlength=len(texts))


def bucket_counts(docs: DataFrame, params: ResampleParams, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                for _, buckets in features(texts, params)[0]:
                    total += np.bincount(buckets, minlength=params.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(params.buckets, np.int64)
    for r in found.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, params: ResampleParams) -> np.ndarray:
    """Log ratio of both smoothed shares of each bucket, in thousandths, rounded down."""
    s_all, t_all = int(source.sum()) + params.buckets, int(target.sum()) + params.buckets
    return np.array([
        math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, params: ResampleParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: `key`, `n_features`, `n_words`, `weight`."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    own = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    key_type = own.schema[0].dataType.simpleString()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                runs, words = features(texts, params)
                total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for row, buckets in runs:
                    each = np.bincount(row, minlength=len(texts))
                    ends = np.cumsum(each)
                    sums = np.concatenate([[0], np.cumsum(np.take(sent.value, buckets))])
                    total += sums[ends] - sums[ends - each]
                    count += each
                mean = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *(pa.array(x, pa.int64()) for x in (count, words, mean))], names=[key, "n_features", "n_words", "weight"])
                at += len(texts)

    return own.mapInArrow(weighed, f"`{key}` {key_type}, n_features long, n_words long, weight long")


def _placed(rows: DataFrame, key: str, share: int) -> DataFrame:
    """`rank` of each row by score, then key, for the first `share` percent of all rows; null for the rest."""
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("_no")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("_no", F.monotonically_increasing_id())
    sorted_rows = numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_no")
    stored = materialise(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(every).alias("_all"))
    rank = F.col("_ahead") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    placed = stored.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return placed.withColumn("rank", F.when(rank <= F.floor(share * F.col("_all") / 100), rank)).drop("_part", "_place", "_ahead", "_all")


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every document: `key`, `n_features`, `n_words`, `weight`, `score` and, of those drawn, the `rank`.

    Of the documents with at least `min_words` words, `percent` percent with the highest scores are drawn.
    """
    gain = gains(bucket_counts(docs, params, text), bucket_counts(target, params, target_text), params)
    hashed = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialise(weigh(docs, gain, params, key, text).withColumn("score", F.col("weight") + noise), "scored")
    long_enough = F.col("n_words") >= params.min_words
    ranked = _placed(scored.where(long_enough), key, params.percent)
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(key, "n_features", "n_words", "weight", "score", "rank")


def oracle(params: ResampleParams = ResampleParams()) -> str:
    """The same for single words as SQL for DuckDB; the CRC is taken byte by byte over the distinct words."""
    upper = "".join(map(chr, range(65, 91)))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with steps as (select list(c order by k) as t from (
    select k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c
    from (select unnest(range(256)) as k))),
docs as (select row_number() over () as no, doc_id, {words} as w from documents),
doc_words as (select no, unnest(w) as word from docs),
target_words as (select unnest({words}) as word from benchmark),
spelled as (select word, list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::bigint) as b
    from (select word from doc_words union select word from target_words)),
hashed as (select word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {params.buckets} as bucket
    from spelled, steps),
s as (select bucket, count(*) as s from doc_words join hashed using (word) group by bucket),
t as (select bucket, count(*) as t from target_words join hashed using (word) group by bucket),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + {params.buckets})
    / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + {params.buckets})))) as g from s full join t using (bucket)),
weighed as (select no, floor(avg(g))::bigint as weight from doc_words join hashed using (word) join gain using (bucket) group by no),
scored as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || left(sha256('{params.seed}:' || doc_id), 8))::bigint + 0.5) / 4294967296)))::bigint as score
    from docs left join weighed using (no)),
ranked as (select *, row_number() over (partition by n_features >= {params.min_words} order by score desc, doc_id) as r,
    count(*) over (partition by n_features >= {params.min_words}) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= {params.min_words} and r <= {params.percent} * n // 100 then r end as rank from ranked"""
