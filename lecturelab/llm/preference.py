"""Preference pairs of conversations as one prompt and two completions with training masks.

A chosen and a rejected conversation of a pair share their first turns. The longest common prefix of turns (same role,
same text) is rendered once as the prompt; what follows in each is its completion. A completion's mask lists the
character spans, from the completion's start, that hold assistant text; only those are trained on.

The turns of a pair meet in one group, which is the row that is returned; nothing larger is ever gathered, and equal
conversations or equal first turns, however many, stay in the groups of their own pairs.

Edge cases: a pair with one conversation only, or whose completions do not both hold assistant text, is `usable` =
false (a missing completion is the empty text); turns are ordered by number, then role and text; repeated rows of a
turn are rendered once; a null role or text is rendered empty; rows without a pair or side are left out; very long
texts are rendered whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


@dataclass(frozen=True)
class Template:
    """A turn is `opening` role `between` text `closing`."""

    opening: str = "<|"
    between: str = "|>\n"
    closing: str = "\n<|end|>\n"


_SPANS = "struct<at:bigint,spans:array<string>>"


def _turns(side: str) -> Column:
    """The distinct turns of one side, in order."""
    turn = F.struct(F.col("_turn").alias("turn"), F.coalesce("_role", F.lit("")).alias("role"), F.coalesce("_text", F.lit("")).alias("text"))
    return F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("_side") == side, turn))))


def _head(turn: Column, t: Template) -> Column:
    return F.concat(F.lit(t.opening), turn["role"], F.lit(t.between))


def rendered(turns: Column, t: Template) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x, t), x["text"], F.lit(t.closing))), "")


def mask(turns: Column, t: Template) -> Column:
    """`from-to` spans of assistant text in the rendering, joined by commas."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(_head(x, t))
        end = start + F.char_length(x["text"])
        span = F.concat_ws("-", start.cast("string"), end.cast("string"))
        spans = F.when(x["role"] == TRAINED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + len(t.closing)).alias("at"), spans.alias("spans")).cast(_SPANS)

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")).cast(_SPANS)
    return F.aggregate(turns, nothing, step, lambda state: F.array_join(state["spans"], ","))


def format_pairs(turns: DataFrame, pair: Column, side: Column, turn: str = "turn", role: str = "role", text: str = "text", template: Template = Template()) -> DataFrame:
    """One row per pair: `pair_id`, `n_shared`, `prompt`, `chosen`, `chosen_mask`, `rejected`, `rejected_mask`, `usable`.

    `side` is `chosen` or `rejected`.
    """
    slim = turns.select(pair.alias("pair_id"), side.alias("_side"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    slim = slim.where(F.col("pair_id").isNotNull() & F.col("_side").isin("chosen", "rejected"))
    both = slim.groupBy("pair_id").agg(_turns("chosen").alias("_c"), _turns("rejected").alias("_r"))
    shorter = F.least(F.size("_c"), F.size("_r"))
    parted = F.filter(
        F.transform("_c", lambda x, i: F.when((i < F.size("_r")) & (x["role"] == F.get("_r", i)["role"]) & (x["text"] == F.get("_r", i)["text"]), F.lit(None)).otherwise(i)),
        lambda i: i.isNotNull())
    both = both.withColumn("_n", F.least(shorter, F.coalesce(F.array_min(parted), shorter)))
    rest = {s: F.slice(s, F.col("_n") + 1, F.size(s)) for s in ("_c", "_r")}
    both = both.withColumns({"_p": F.slice("_c", 1, F.col("_n")), "_c": rest["_c"], "_r": rest["_r"]})
    out = both.select(
        "pair_id", F.col("_n").cast("long").alias("n_shared"), rendered(F.col("_p"), template).alias("prompt"),
        rendered(F.col("_c"), template).alias("chosen"), mask(F.col("_c"), template).alias("chosen_mask"),
        rendered(F.col("_r"), template).alias("rejected"), mask(F.col("_r"), template).alias("rejected_mask"))
    return out.withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


def with_other_answers(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pairs of conversations with whole-numbered `key`s: the turns of each as `_side` chosen, and as rejected the same turns
    with the last assistant turn's text taken from the conversation with the next key. A conversation without an answer, or
    whose neighbour has none, has no rejected side."""
    plain = turns.where(F.col(key).isNotNull()).select(key, turn, F.coalesce(role, F.lit("")).alias(role), F.coalesce(text, F.lit("")).alias(text))
    last = plain.where(F.col(role) == TRAINED).groupBy(key).agg(F.max(F.struct(turn, text)).alias("_a"))
    own = last.select(key, F.col(f"_a.{turn}").alias("_last"))
    other = last.select((F.col(key) - 1).alias(key), F.col(f"_a.{text}").alias("_other"))
    answer = (F.col(role) == TRAINED) & F.col(turn).eqNullSafe(F.col("_last"))
    rejected = plain.join(own.join(other, key), key).withColumn(text, F.when(answer, F.col("_other")).otherwise(F.col(text)))
    return plain.withColumn("_side", F.lit("chosen")).unionByName(rejected.drop("_last", "_other").withColumn("_side", F.lit("rejected")))


def oracle(t: Template = Template()) -> str:
    """SQL for DuckDB, for each conversation and itself with the next one's last answer."""

    def text(value: str) -> str:
        return "(" + " || chr(10) || ".join(f"'{part}'" for part in value.split("\n")) + ")"

    head, tail = f"{text(t.opening)} || role || {text(t.between)}", text(t.closing)
    return f"""
with plain as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
answers as (select * from plain where role = '{TRAINED}'
    qualify row_number() over (partition by conv_id order by turn desc nulls last, text desc) = 1),
turns as (select conv_id as pair_id, 0 as side, turn, role, text from plain
    union select p.conv_id, 1, p.turn, p.role, case when p.role = '{TRAINED}' and p.turn is not distinct from a.turn then o.text else p.text end
    from plain p join answers a on a.conv_id = p.conv_id join answers o on o.conv_id = p.conv_id + 1),
placed as (select *, row_number() over (partition by pair_id, side order by turn, role, text) - 1 as k from turns),
sizes as (select pair_id, count(*) filter (side = 0) as nc, count(*) filter (side = 1) as nr from placed group by 1),
same as (select a.pair_id, min(case when b.k is null then a.k end) as k from (select * from placed where side = 0) a
    left join (select * from placed where side = 1) b on a.pair_id = b.pair_id and a.k = b.k and a.role = b.role and a.text = b.text group by 1),
shared as (select pair_id, least(nc, nr, coalesce(k, least(nc, nr))) as n from sizes left join same using (pair_id)),
drawn as (select p.*, n, {head} || text || {tail} as piece, length({head}) as lead from placed p join shared using (pair_id)),
spots as (select *, sum(length(piece)) over (partition by pair_id, side, k >= n order by k) - length(piece) + lead as start from drawn),
made as (select pair_id, n,
    coalesce(string_agg(piece, '' order by k) filter (side = 0 and k < n), '') as prompt,
    coalesce(string_agg(piece, '' order by k) filter (side = 0 and k >= n), '') as chosen,
    coalesce(string_agg(start::bigint || '-' || (start + length(text))::bigint, ',' order by k) filter (side = 0 and k >= n and role = '{TRAINED}'), '') as chosen_mask,
    coalesce(string_agg(piece, '' order by k) filter (side = 1 and k >= n), '') as rejected,
    coalesce(string_agg(start::bigint || '-' || (start + length(text))::bigint, ',' order by k) filter (side = 1 and k >= n and role = '{TRAINED}'), '') as rejected_mask
    from spots group by pair_id, n)
select pair_id, n::bigint as n_shared, prompt, chosen, chosen_mask, rejected, rejected_mask, chosen_mask <> '' and rejected_mask <> '' as usable from made"""
