"""Near copies by SimHash, with pigeonring candidates.

A fingerprint has 64 bits; two link if they differ in at most `distance` bits. The bits are cut into
`SEGMENTS` consecutive segments that form a ring. If two fingerprints differ in at most d bits, some chain of
consecutive segments keeps every prefix within its proportional share: the first j segments of the chain differ in at
most floor(j * d / SEGMENTS) bits together. So candidates are pairs that agree on such a chain of `CHAIN` segments:
each fingerprint is stored under the bits of its chains and looked up under every change of them that the budgets
allow. The full Hamming distance is then checked.

Rows: a chain of two out of three segments fixes 42 or 43 bits, so a lookup meets few strangers. Equal
fingerprints are one row before anything is looked up, however many documents share them; documents meet their
fingerprint's component again in a join that Spark may split (large groups of copies).

Edge cases: a text without a word (or null) has fingerprint zero and is linked like any other; one or two words are
one shingle; texts are taken whole, shingle counts are kept for blocks of a text; a null id stays null and does not
name a component unless its whole component has none; repeated rows appear as often as given; an empty table gives an
empty result.

Similar texts (`similar_clusters`, `similar_only_once`) are those whose sets of five-word shingles overlap by `SIMILAR`
percent or more; two bits of a SimHash find few of them and a wide distance finds too many strangers, so candidates come
from min-wise hashes: `BANDS` bands of `BAND` minima each, which a pair of similarity 0.8 misses altogether once in
20 000 times, and a pair of higher similarity less often. Every candidate is confirmed on the sets themselves.

A band's texts first meet one of them, another one in each band. Where that leaves several components in a band, each of
them sends `ROUNDS` members, drawn anew each round, and these meet the members of two components of the band: one drawn
by the round and the largest. That joins most of what belongs together with pairs in proportion to the texts. Then all texts
of different components of a band meet by their sketches, so no link of a band is left out. A sketch has a few bits for each
shingle, each telling whether an odd number of shingles falls on it; two sketches differ in no more bits than the sets in
shingles, so a pair whose sketches differ in too many is not similar, and the others are confirmed on the sets. Sketches meet
in blocks of at most `MET_ROWS` texts and `MET_BYTES`, which bounds the memory of a task; the comparisons of sketches grow
with the square of a group of templates, the pairs that are written do not, unless they are just about similar.
`exact=True` writes all those pairs out instead of meeting by sketches; the result is the same.

Equal words in a row are one text. A text without a word is like other such texts only. What is kept of a component is
decided by row, not by id alone: the row with the smallest id (rows without one come last), and among those with
the smallest hash; of rows with that id and equal words one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from lecturelab.llm.common import materialise
from lecturelab.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 3
CHAIN = 2
BITS = 64
_BLOCK = 1 << 16
#: Words in a shingle of similar texts, and the percentage of all shingles of two texts that both must have.
SIMILAR_SHINGLE = 5
SIMILAR = 80
BANDS = 25
BAND = 5
_MIN_BLOCK = 1 << 10
#: Members that each component of a band sends to meet others.
ROUNDS = 3
#: Texts of a block in which sketches meet, and the bytes of their sketches.
MET_ROWS = 1 << 12
MET_BYTES = 1 << 22
#: Words of sketches that are compared at once.
_MET_WORDS = 1 << 20
#: Parts that the rows of a band are dealt into where they meet what the band has once.
PARTS = 16


def _spans(text: str | None, shingle: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between, and where each shingle starts and ends."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space parts
    joined, lengths = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(tokens))
    return joined, starts[: len(tokens) - width + 1], ends[max(width - 1, 0):]


def _span_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")


def simhash(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    joined, starts, ends = _spans(text, SHINGLE)
    if not joined:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = _span_hashes(joined, starts[at: at + _BLOCK], ends[at: at + _BLOCK])
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(t) for t in batch], dtype="int64")


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the different five-word shingles, in order; a shorter text is one shingle."""
    return np.unique(_span_hashes(*_spans(text, SIMILAR_SHINGLE)))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the min-wise hashes."""
    drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND, 1), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.int64)
    factors, summands = _factors()
    least = np.full(BANDS * BAND, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _MIN_BLOCK):
        least = np.minimum(least, (hashes[None, at: at + _MIN_BLOCK] * factors + summands).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, BAND)
    return np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], dtype="<u8").view("<i8")


def _words_number(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    number = xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), SEED)
    return number - (1 << 64) if number >> 63 else number


@F.pandas_udf(LongType())
def words_hash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Equal for equal words in a row."""
    for batch in texts:
        yield pd.Series([_words_number(t) for t in batch], dtype="int64")


@F.pandas_udf(StructType().add("fp", LongType()).add("bands", ArrayType(LongType())).add("sim", LongType()))
def text_marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The hash of the words, the bands and the fingerprint of each text, by one worker: three functions side by side keep three for each core."""
    for batch in texts:
        yield pd.DataFrame({
            "fp": pd.Series([_words_number(t) for t in batch], dtype="int64"), "bands": pd.Series([bands(shingles(t)) for t in batch], dtype=object),
            "sim": pd.Series([simhash(t) for t in batch], dtype="int64")})


@F.pandas_udf(ArrayType(LongType()))
def text_bands(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([bands(shingles(t)) for t in batch], dtype=object)


def sketch(hashes: np.ndarray) -> bytes:
    """A bit for each of two to four times as many places as shingles (64 at least, a power of two): whether an odd number falls there."""
    width = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes.view(np.uint64) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


@F.pandas_udf(StructType().add("s", ArrayType(LongType())).add("n", LongType()).add("sketch", BinaryType()))
def text_sets(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The shingles of each text, their number and sketch."""
    for batch in texts:
        own = [shingles(t) for t in batch]
        yield pd.DataFrame({
            "s": pd.Series([h.view("<i8") for h in own], dtype=object), "n": pd.Series([len(h) for h in own], dtype="int64"),
            "sketch": pd.Series([sketch(h) for h in own], dtype=object)})


def fingerprint_text(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def segments(parts: int = SEGMENTS) -> list[list[int]]:
    """Bit numbers of each segment."""
    edges = [BITS * k // parts for k in range(parts + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def chains(distance: int = DISTANCE, parts: int = SEGMENTS, length: int = CHAIN) -> list[tuple[int, list[int]]]:
    """For each start on the ring: the bits of its chain, and every change of them within the budgets."""
    cut, out = segments(parts), []
    for start in range(parts):
        ring = [cut[(start + j) % parts] for j in range(length)]
        changes = [(0, 0)]
        for j, segment in enumerate(ring):
            budget = (j + 1) * distance // parts
            changes = [
                (mask | sum(1 << bit for bit in flipped), used + k)
                for mask, used in changes for k in range(budget - used + 1) for flipped in combinations(segment, k)]
        out.append((sum(1 << bit for segment in ring for bit in segment), [mask for mask, _ in changes]))
    return out


def links(values: DataFrame, column: str = "fp", distance: int = DISTANCE, parts: int = SEGMENTS, length: int = CHAIN) -> DataFrame:
    """`a` < `b`: pairs of different fingerprints at most `distance` bits apart. `column` must hold each value once."""
    ring = chains(distance, parts, length)
    kept = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(_signed(bits)).alias("bits")) for s, (bits, _) in enumerate(ring)]))
    tried = F.explode(F.array(*[
        F.struct(F.lit(s).alias("start"), F.lit(_signed(bits)).alias("bits"), F.lit(_signed(change)).alias("change"))
        for s, (bits, changes) in enumerate(ring) for change in changes]))
    stored = values.select(F.col(column).alias("b"), kept.alias("c")).select(
        "b", F.col("c.start").alias("start"), F.col("b").bitwiseAND(F.col("c.bits")).alias("chain"))
    looked = values.select(F.col(column).alias("a"), tried.alias("c")).select(
        "a", F.col("c.start").alias("start"), F.col("a").bitwiseAND(F.col("c.bits")).bitwiseXOR(F.col("c.change")).alias("chain"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # a pair that several chains find is reported by the first of them
    earlier = F.lit(False)
    for s, (bits, changes) in enumerate(ring):
        viable = differ.bitwiseAND(F.lit(_signed(bits))).isin([_signed(c) for c in changes])
        earlier = earlier | ((F.col("start") > s) & viable)
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance)
    # Spark judges both sides by the table they come from, not by the rows they turn into, and would broadcast a small one
    return looked.hint("merge").join(stored, ["start", "chain"]).where(near & ~earlier).select("a", "b")


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: `key`, `fp`, and the smallest key reachable over links as `component_id`."""
    own = materialise(docs.select(F.col(key), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    values = materialise(own.groupBy("fp").agg(F.min(key).alias("_first")), "values")
    return _named(own, values, connected_components(links(values, "fp", distance)), key)


def _named(own: DataFrame, values: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """`own` (key, `fp`) with the smallest key (`_first` in `values`) of the component that `labels` tells."""
    linked = values.hint("merge").join(labels, F.col("fp") == F.col("node")).select("fp", "_first", "label")
    roots = linked.groupBy("label").agg(F.min("_first").alias("_root"))
    reached = linked.hint("merge").join(roots, "label").select("fp", "_root")
    # stored, so that both sides of the last join are plain shuffles and a hot fingerprint can be split
    named = materialise(values.hint("merge").join(reached, "fp", "left").select("fp", F.coalesce("_root", "_first").alias("component_id")), "components")
    return own.join(named, "fp").select(key, "fp", "component_id")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (`a`, `b`) that are similar; `sets` has the shingles `s` of each `fp`."""
    one, other = (sets.select(F.col("fp").alias(side), F.col("s").alias(f"s{side}")) for side in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    n, m = F.size("sa"), F.size("sb")
    met = pairs.hint("merge").join(one, "a").hint("merge").join(other, "b")
    # lengths first: they are read without a look at the shingles
    return met.where((100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & (100 * both >= SIMILAR * (n + m - both))).select("a", "b")


def _told(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """`rows` with what `bands` (one row a band) says of their band; the rows of a hot band are dealt into parts."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int"))
    return dealt.hint("merge").join(bands.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["band", "_part"]).drop("_part")


def _pair(x: Column, y: Column) -> Column:
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _sent(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """`a` < `b`: pairs of drawn members of different components of a band."""
    many = shared.hint("merge").join(labels, F.col("fp") == F.col("node"), "left").select("band", "fp", F.coalesce("label", "fp").alias("label"))
    drawn = [F.min_by("fp", F.xxhash64("fp", "band", F.lit(r))).alias(f"m{r}") for r in range(ROUNDS)]
    parts = materialise(many.groupBy("band", "label").agg(F.count("*").alias("n"), *drawn), "parts")
    stars = [F.min_by(f"m{r}", F.xxhash64("label", "band", F.lit(r))).alias(f"s{r}") for r in range(ROUNDS)]
    largest = [F.max_by(f"m{r}", F.struct("n", "label")).alias(f"g{r}") for r in range(ROUNDS)]
    split = parts.groupBy("band").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), *stars, *largest).where("_l < _h")
    met = _told(parts.withColumnRenamed("label", "fp"), split)
    pairs = F.array(*[_pair(F.col(f"m{r}"), F.col(f"{kind}{r}")) for r in range(ROUNDS) for kind in "sg"])
    return met.select(F.explode(F.array_distinct(pairs)).alias("p")).select("p.*").where("a < b").distinct()


def _crossed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """`a` < `b`: all pairs of members of different components of a band."""
    many = shared.hint("merge").join(labels, F.col("fp") == F.col("node"), "left").select("band", "fp", F.coalesce("label", "fp").alias("label"))
    parts = materialise(many, "labelled")
    names = parts.select("band", "label").distinct()
    low, high = names.select("band", F.col("label").alias("la")), names.select("band", F.col("label").alias("lb"))
    across = low.hint("merge").join(high, "band").where("la < lb")
    one = parts.select("band", F.col("label").alias("la"), F.col("fp").alias("x"))
    other = parts.select("band", F.col("label").alias("lb"), F.col("fp").alias("y"))
    crossed = across.hint("merge").join(one, ["band", "la"]).hint("merge").join(other, ["band", "lb"])
    return crossed.select(_pair(F.col("x"), F.col("y")).alias("p")).select("p.*").distinct()


def _open_pairs(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """Pairs of `fp` of different labels that sizes and sketches leave open. A side is `fp`, `label`, size, sketches; `other` None: inside `one`."""
    fp, label, n, bits = one
    fp_2, label_2, m, bits_2 = one if other is None else other
    if bits_2.shape[1] > bits.shape[1]:  # places are last bits of a hash: twice as many fold by halves
        bits_2 = bits_2[:, : bits.shape[1]] ^ bits_2[:, bits.shape[1]:]
    found, step = [np.zeros((2, 0), np.int64)], max(1, _MET_WORDS // max(1, bits_2.size))
    for at in range(0, len(fp), step):
        k = slice(at, at + step)
        both = n[k, None] + m
        may = (label[k, None] != label_2) & (100 * np.minimum(n[k, None], m) >= SIMILAR * np.maximum(n[k, None], m))
        if other is None:
            may &= fp[k, None] < fp_2
        if may.any():
            apart = np.bitwise_count(bits[k, None] ^ bits_2).sum(axis=2, dtype=np.int64)
            x, y = np.nonzero(may & ((100 + SIMILAR) * apart <= (100 - SIMILAR) * both))
            found.append(np.stack([np.minimum(fp[at + x], fp_2[y]), np.maximum(fp[at + x], fp_2[y])]))
    return np.concatenate(found, axis=1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pairs of each meeting (`band`, `width`, `lo`, `hi`) of two blocks; rows come in the order of meetings and blocks (`at`)."""

    def side(rows: pa.Table) -> tuple[np.ndarray, ...]:
        bits = np.frombuffer(b"".join(rows["sketch"].to_pylist()), "<u8").reshape(len(rows), -1)
        return (*(rows[c].to_numpy() for c in ("fp", "label", "n")), bits)

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        keys = np.stack([rows[c].to_numpy() for c in ("band", "width", "lo", "hi", "at")])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(rows)]
        sides = {tuple(keys[:, a].tolist()): rows.slice(a, b - a) for a, b in zip(starts, starts[1:], strict=False)}
        found = [np.zeros((2, 0), np.int64)]
        for (*meeting, lo, hi, at), own in sides.items():
            if at == lo and (lo == hi or (*meeting, lo, hi, hi) in sides):
                found.append(_open_pairs(side(own), None if lo == hi else side(sides[*meeting, lo, hi, hi])))
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        keys = np.stack([rows[c].to_numpy() for c in ("band", "width", "lo", "hi")])
        last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1  # the last meeting may go on
        if last:
            yield pairs(rows.slice(0, last))
        rest = rows.slice(last)
    if rest is not None:
        yield pairs(rest)


def _sketched(shared: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """`a` < `b`: pairs of members of different components of a band, all but those whose sketches say that they are not similar.

    Texts of a band meet others of the same width of sketch and of twice that width; no pair of further widths is similar.
    """
    many = shared.hint("merge").join(labels, F.col("fp") == F.col("node"), "left").select("band", "fp", F.coalesce("label", "fp").alias("label"))
    many = materialise(many, "labelled")
    # two texts of a band have met: one of them was the star
    split = many.groupBy("band").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.count("*").alias("_n")).where("_l < _h and _n > 2")
    sketches = sets.select("fp", "n", F.octet_length("sketch").cast("long").alias("width"), "sketch")
    rows = materialise(_told(many, split.select("band")).hint("merge").join(sketches, "fp"), "members")
    rows_of = rows.groupBy("band", "width").agg(F.count("*").alias("_n"))
    sizes = rows_of.select("band", "width", F.ceil(F.greatest(F.col("_n") / MET_ROWS, F.col("_n") * F.col("width") / MET_BYTES)).alias("_own"))
    sizes = materialise(sizes, "blocks")
    for name, factor in (("_wider", 2), ("_narrower", 0.5)):
        beside = sizes.select("band", (F.col("width") / factor).cast("long").alias("width"), F.col("_own").alias(name))
        sizes = sizes.hint("merge").join(beside, ["band", "width"], "left")
    parts = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    own, wider, narrower = "_own", F.coalesce("_wider", F.lit(0).cast("long")), F.coalesce("_narrower", F.lit(0).cast("long"))
    place = F.pmod(F.xxhash64("fp"), F.col(own))
    numbers = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda k: k < n)
    meeting = lambda width, lo, hi, at: F.struct(
        width.cast("long").alias("width"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), at.cast("long").alias("at"))
    # a wider block j is block `_own` + j of the narrower width
    met = F.concat(
        F.transform(numbers(F.col(own)), lambda j: meeting(F.col("width"), F.least(place, j), F.greatest(place, j), place)),
        F.transform(numbers(wider), lambda j: meeting(F.col("width"), place, F.col(own) + j, place)),
        F.transform(numbers(narrower), lambda j: meeting(F.col("width") / 2, j, narrower + place, narrower + place)))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).hint("merge").join(parts, ["band", "width", "_part"])
    dealt = dealt.select("band", F.explode(met).alias("_m"), "fp", "label", "n", "sketch").select("band", "_m.*", "fp", "label", "n", "sketch")
    meetings = ["band", "width", "lo", "hi"]
    return dealt.repartition(*meetings).sortWithinPartitions(*meetings, "at").mapInArrow(_meet, "a long, b long").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` after `links` (`a`, `b`) between members; texts without a label are components of their own."""
    before = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    # links between components, each named by its label
    named = links.hint("merge").join(before, F.col("a") == F.col("_n"), "left").select(F.coalesce("_l", "a").alias("a"), "b")
    named = named.hint("merge").join(before, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_l", "b").alias("b")).distinct()
    joined = connected_components(named).select(F.col("node").alias("_n"), F.col("label").alias("_to"))
    both = labels.unionByName(joined.select(F.col("_n").alias("node"), F.col("_n").alias("label")))
    return both.hint("merge").join(joined, F.col("label") == F.col("_n"), "left").groupBy("node").agg(F.min(F.coalesce("_to", "label")).alias("label"))


def similar_labels(docs: DataFrame, own: DataFrame, text: str = "text", exact: bool = False) -> DataFrame:
    """`node`, `label`: the component of each `fp` of `own` (`fp`, `bands`) that has a similar text."""
    members = own.select("fp", F.explode("bands").alias("band")).distinct()
    met = members.groupBy("band").agg(F.count("*").alias("n"), F.min(F.col("fp").bitwiseXOR(F.col("band"))).alias("_min")).where("n > 1").drop("n")
    shared = materialise(_told(members, met).select("band", "fp", F.col("_min").bitwiseXOR(F.col("band")).alias("star")), "shared")
    texts = docs.select(words_hash(F.col(text)).alias("fp"), F.col(text).alias("_text")).hint("merge").join(shared.select("fp").distinct(), "fp", "left_semi")
    sets = materialise(texts.dropDuplicates(["fp"]).select("fp", text_sets("_text").alias("_s")).select("fp", "_s.*"), "shingles")
    star = shared.where("fp <> star").select(_pair(F.col("fp"), F.col("star")).alias("p")).select("p.*").distinct()
    labels = connected_components(_confirmed(star, sets))
    if exact:
        return _joined(labels, _confirmed(_crossed(shared, labels), sets))
    drawn = materialise(_sent(shared, labels), "drawn")
    labels = materialise(_joined(labels, _confirmed(drawn, sets)), "labels-drawn")
    left = _sketched(shared, labels, sets).hint("merge").join(drawn, ["a", "b"], "left_anti").hint("merge").join(star, ["a", "b"], "left_anti")
    rest = materialise(_confirmed(left, sets), "links-left")
    return labels if rest.isEmpty() else _joined(labels, rest)


def _similar(docs: DataFrame, key: str, text: str, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = materialise(docs.select(F.col(key), words_hash(F.col(text)).alias("fp"), text_bands(F.col(text)).alias("bands")), "words")
    values = materialise(own.groupBy("fp").agg(F.min(key).alias("_first")), "values")
    return own.select(key, "fp"), values, similar_labels(docs, own, text, exact)


def similar_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """One row per document: `key`, `fp` (of its words in a row), and the smallest key reachable over similar texts."""
    return _named(*_similar(docs, key, text, exact), key)


def similar_only_once(docs: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """As `deduplicate`, by similar texts."""
    _, values, labels = _similar(docs, key, text, exact)
    return _first_of_each(docs, words_hash(F.col(text)), values, labels, key)


def near_only_once(docs: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """As `deduplicate`, by links of fingerprints and by similar texts together: a component holds both kinds of links.

    Each text is read once for its fingerprint, its words and its bands. Texts whose fingerprints are of one component are
    linked to the smallest of them, so no group of copies is paired up.
    """
    own = materialise(docs.select(F.col(key), text_marks(F.col(text)).alias("_m")).select(key, "_m.*"), "words")
    # equal words have equal fingerprints
    values = materialise(own.groupBy("fp").agg(F.min(key).alias("_first"), F.min("sim").alias("sim")), "values")
    near = connected_components(links(materialise(values.select("sim").distinct(), "fingerprints"), "sim"))
    classes = values.hint("merge").join(near, F.col("sim") == F.col("node"), "left").select("fp", F.coalesce("label", "sim").alias("class"))
    classes = materialise(classes, "classes")
    hubs = classes.groupBy("class").agg(F.min("fp").alias("b"), F.max("fp").alias("_most")).where("b < _most").drop("_most")
    by_fingerprint = classes.hint("merge").join(hubs, "class").where("fp <> b").select(F.col("fp").alias("a"), "b")
    by_words = similar_labels(docs, own, text, exact).select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = connected_components(by_fingerprint.unionByName(by_words))
    return _first_of_each(docs, words_hash(F.col(text)), values, labels, key)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each component, as said above; an id that several texts share decides for none of them."""
    own = docs.select(F.col(key), fingerprint(F.col(text)).alias("fp"))
    values = materialise(own.groupBy("fp").agg(F.min(key).alias("_first")), "values")
    return _first_of_each(docs, fingerprint(F.col(text)), values, connected_components(links(values, "fp", distance)), key)


def _first_of_each(docs: DataFrame, fp: Column, values: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` whose `fp` and key are the first of their component."""
    named = values.hint("merge").join(labels, F.col("fp") == F.col("node"), "left")
    first = named.groupBy(F.coalesce("label", "fp").alias("_label")).agg(F.min(F.struct(F.col("_first").isNull().alias("none"), "_first", "fp")).alias("_r"))
    chosen = materialise(first.select(F.col("_r.fp").alias("_chosen"), F.col("_r._first").alias("_first")), "chosen")
    hashed = docs.withColumn("_fp", fp)
    same = (F.col("_fp") == F.col("_chosen")) & F.col(key).eqNullSafe(F.col("_first"))
    return hashed.hint("merge").join(chosen, same, "left_semi").dropDuplicates(["_fp", key]).drop("_fp")
