"""Benchmark passages in training texts, found by spaced seeds.

A seed is a fixed mask over consecutive words: the words under `1` are hashed, those under `0` may differ. Windows of
training texts and benchmark items with equal hashes meet in a join; around each hit, the benchmark words within
`PAD` places (cut to the item) are compared with the text's words at the same distance. The text holds the passage if
at least `PERCENT` of them agree, so single replaced words do not hide it, or if `RUN` of them in a row agree, so that an
excerpt counts from any place of the item, whatever stands around it. Verbatim excerpts of `RUN` words are found in
any case: the masks match at their first word, and the comparison reaches far enough.

Words are runs of letters and digits in lower case. All masks are made of pairs of neighbouring words, so one
array of pair hashes serves them all, and only hashes and places are dealt out per window, never words. Windows whose
hash cannot be in the benchmark are dropped by a bit table of fixed size, which only saves rows; a join on the hashes
decides. The documents with hits then meet them again by id, once, to cut the words around each. Benchmark windows with
equal surroundings are one row, named after the smallest item.

Edge cases: null or empty texts and items, and those of fewer than `SPAN` words, hold no window and match nothing (the
fourth mask has seven places, but is laid where eight words are left); repeated rows add nothing; very long texts are
streamed window by window from their word list; rows without an id can't be named and are not reported by `leaks`, while
`remove` decides by the text of the row, whatever its id; an empty benchmark or table gives an empty result. Only the id
and text columns are read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.llm.common import materialise, text_or_empty, where_computed

#: Where the second and the third pair of a mask start; the first starts at 0.
PAIRS = ((3, 6), (2, 6), (4, 6))
SPAN = 8
SEEDS = tuple("".join("1" if any(k in (at, at + 1) for at in (0, *rest)) else "0" for k in range(SPAN)) for rest in PAIRS)
#: One more mask, of four pairs, whose gaps are four places apart: 1110111.
FOURTH = (1, 4, 5)
FOURTH_SEED = "".join("1" if any(k in (at, at + 1) for at in (0, *FOURTH)) else "0" for k in range(FOURTH[-1] + 2))
MASKS = len(PAIRS) + 1
PAD = 8
PERCENT = 70
#: Agreeing words in a row that are a passage by themselves.
RUN = 13
#: 2^17 words of 64 bits, 1 MB, whatever the benchmark holds.
BIT_POWER = 17
NOT_WORD = r"[^\p{L}\p{N}]+"


def passage_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty(text)), NOT_WORD), "")


def _places(seed: str) -> list[int]:
    return [k for k, c in enumerate(seed) if c == "1"]


def _with(hashes: Column | str, others: Column | str, ahead: int) -> Column:
    """Each hash combined with the one `ahead` places on in `others`, as far as both go."""
    n = F.greatest(F.least(F.size(hashes), F.size(others) - ahead), F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(others, ahead + 1, n), lambda a, b: F.xxhash64(a, b))


def _hashes(texts: DataFrame) -> DataFrame:
    """`texts` (`_k`, `_w`) to `_k`, `i` and the hash of every mask there, one row per place."""
    out = texts.select("_k", F.transform("_w", lambda w: F.xxhash64(w)).alias("_p"))
    out = out.withColumn("_p", _with("_p", "_p", 1))
    out = out.select("_k", "_p", *[_with("_p", "_p", second).alias(f"_q{n}") for n, second in enumerate((*[second for second, _ in PAIRS], FOURTH[0]))])
    last = _with(_with(f"_q{MASKS - 1}", "_p", FOURTH[1]), "_p", FOURTH[2])
    out = out.select("_k", *[_with(f"_q{n}", "_p", third).alias(f"h{n}") for n, (_, third) in enumerate(PAIRS)], last.alias(f"h{MASKS - 1}"))
    names = [f"h{n}" for n in range(MASKS)]
    return out.select("_k", F.posexplode(F.arrays_zip(*names)).alias("i", "h")).select("_k", "i", "h.*")


def _each(hashed: DataFrame, bits: Column | None = None) -> DataFrame:
    """`_k`, `i`, `seed`, `hash`: one row per mask, those only that `bits` lets pass."""
    names = range(MASKS)
    some = hashed.where("h0 is not null")  # the fourth mask is shorter and would go one window further
    if bits is not None:
        # each mask looks at the table once: every mention of it is sent to the tasks and planned by itself
        some = some.withColumns({f"p{n}": _passes(F.col(f"h{n}"), bits) for n in names})
        some = where_computed(some, reduce(or_, [F.col(f"p{n}") for n in names]))
    rows = [F.when(F.lit(True) if bits is None else F.col(f"p{n}"), F.struct(F.lit(n).alias("seed"), F.col(f"h{n}").alias("hash"))) for n in names]
    return some.select("_k", "i", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("_k", "i", "s.*")


def _around(texts: DataFrame) -> DataFrame:
    """`texts` (`_k`, `_w`, `_hits` of i, seed, hash) to `_k`, `seed`, `hash`, `before`, `near`: the words around each hit."""
    # cut word by word: a slice would unpack the whole text for every window
    cut = F.transform("_hits", lambda x: F.struct(
        x["seed"].alias("seed"), x["hash"].alias("hash"), F.least(x["i"], F.lit(PAD)).alias("before"),
        F.transform(
            F.sequence(F.greatest(x["i"] - PAD, F.lit(0)), F.least(x["i"] + SPAN + PAD, F.size("_w")) - 1), lambda k: F.get("_w", k)).alias("near")))
    return texts.select("_k", cut.alias("_hits")).select("_k", F.inline("_hits"))


def _gathered(rows: DataFrame) -> DataFrame:
    """The hits of each text in one list: no more than four for each of its words, however often the text is given."""
    return rows.groupBy("_k").agg(F.collect_set(F.struct("i", "seed", "hash")).alias("_hits"))


def _spot(value: Column) -> tuple[Column, Column]:
    """Where a hash is in the table: its word, told by the first bits, and three bits of that word, told by the last ones."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(value, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(3)]
    return F.shiftrightunsigned(value, 64 - BIT_POWER).cast("int"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _passes(value: Column, bits: Column) -> Column:
    word, own = _spot(value)
    return F.get(bits, word).bitwiseAND(own) == own


def bit_table(index: DataFrame) -> Column:
    """The bit table of the index's hashes, as a scalar that every task gets. It is stored, so that a mention of it plans a read only."""
    word, own = _spot(F.col("hash"))
    filled = index.groupBy(word.cast("long").alias("id")).agg(F.bit_or(own).alias("bits"))
    whole = index.sparkSession.range(0, 1 << BIT_POWER, 1, 8).join(filled, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return materialise(whole.agg(F.transform(rows, lambda r: r["bits"]).alias("bits")), "bits").scalar()


def benchmark_index(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """`seed`, `hash`, `near`, `before`, `item` (the smallest with these words around the window)."""
    slim = items.groupBy(passage_words(F.col(text)).alias("_w")).agg(F.min(key).alias("_k")).where(F.col("_k").isNotNull())
    own = slim.join(_gathered(_each(_hashes(slim))), "_k")
    return _around(own).groupBy("seed", "hash", "near", "before").agg(F.min("_k").alias("item"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, `item_id`, `matched`: documents that hold a passage of an item, with the most words that agree around a hit."""
    index = materialise(benchmark_index(items, item_key, item_text), "benchmark")
    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), passage_words(F.col(text)).alias("_w"))
    hits = _each(_hashes(slim), bit_table(index)).join(index.select("seed", "hash").distinct(), ["seed", "hash"], "left_semi")
    found = materialise(_gathered(hits), "hits")
    theirs = index.withColumnsRenamed({"near": "item_near", "before": "item_before"})
    met = _around(slim.join(found, "_k")).join(theirs, ["seed", "hash"])
    shift = F.col("before") - F.col("item_before")
    same = F.transform("item_near", lambda w, k: F.coalesce(w == F.get(F.col("near"), k + shift), F.lit(False)))
    none = F.struct(F.lit(0).alias("all"), F.lit(0).alias("now"), F.lit(0).alias("run"))
    agree = F.aggregate(same, none, lambda a, x: F.struct(
        (a["all"] + x.cast("int")).alias("all"), F.when(x, a["now"] + 1).otherwise(0).alias("now"),
        F.greatest(a["run"], F.when(x, a["now"] + 1).otherwise(0)).alias("run")))
    counted = met.select("_k", "item", F.size("item_near").alias("compared"), agree.alias("agree"))
    checked = counted.select("_k", "item", "compared", F.col("agree.all").cast("long").alias("matched"), F.col("agree.run").alias("run")).where(
        (100 * F.col("matched") >= PERCENT * F.col("compared")) | (F.col("run") >= RUN))
    return checked.groupBy(F.col("_k").alias(key), F.col("item").alias("item_id")).agg(F.max("matched").alias("matched"))


def remove(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the rows whose text holds a benchmark passage."""
    named = docs.withColumn("_own", F.md5(text_or_empty(F.col(text))))
    found = leaks(named.select("_own", F.col(text).alias("_text")), items, "_own", "_text").select("_own").distinct()
    return named.join(found, "_own", "left_anti").drop("_own")


def oracle() -> str:
    """The same result as SQL for DuckDB, joining the words under the masks themselves."""

    def side(table: str, key: str) -> str:
        words = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{NOT_WORD}'), lambda x: x <> '')"
        parts = []
        for n, seed in enumerate((*SEEDS, FOURTH_SEED)):
            shown = ", ' ', ".join(f"w[i + {k + 1}]" for k in _places(seed))
            spots = f"range(0, len(w) - {SPAN} + 1)"
            parts.append(
                f"select rid, {n} as seed, unnest({spots}) as i, "
                f"unnest(list_transform({spots}, lambda i: concat({shown}))) as words from {table}_w where len(w) >= {SPAN}")
        return (f"{table}_w as (select row_number() over () as rid, {key} as id, {words} as w from {table}),\n"
                f"{table}_s as ({' union all '.join(parts)})")

    return f"""
with {side('documents', 'doc_id')},
{side('benchmark', 'item_id')},
items as (select s.seed, s.words, least(s.i, {PAD}) as item_before,
        w.w[s.i - least(s.i, {PAD}) + 1 : s.i + {SPAN + PAD}] as item_near, min(w.id) as item_id
    from benchmark_s s join benchmark_w w using (rid) group by all),
met as (select d.rid, d.i, x.* from documents_s d join items x using (seed, words)),
checked as (select w.id as doc_id, item_id, array_to_string(list_transform(range(0, len(item_near)),
        lambda k: case when i - item_before + k >= 0 and w.w[i - item_before + k + 1] = item_near[k + 1] then '1' else '0' end), '') as agree
    from met join documents_w w using (rid) where w.id is not null),
counted as (select doc_id, item_id, agree, length(replace(agree, '0', '')) as matched from checked)
select doc_id, item_id, max(matched)::bigint as matched from counted
where 100 * matched >= {PERCENT} * length(agree) or contains(agree, '{'1' * RUN}') group by all"""
