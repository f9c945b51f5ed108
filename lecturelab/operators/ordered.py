"""Ordered computations per key that never put a whole key into one task.

A single recording may hold a large share of all rows, so a plain window over
`lecture_id` would end in one task. Everything here cuts a key into *blocks* of its
order (`index div size`, or any column that does not decrease along the order), works
inside `(key, block)`, and carries one small summary row per block across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def block_of(index: Column, size: int = BLOCK_ROWS) -> Column:
    return F.floor(index / F.lit(size)).cast("long")


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    columns: dict[str, tuple[str, int]],
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of the row `offset` places away: `{new_column: (column, offset)}`.

    `index` must be dense inside a key. Rows near a block edge are copied into the
    neighbouring block, so one shuffle on `(keys, block)` is enough.
    """
    back = max([-o for _, o in columns.values() if o < 0], default=0)
    ahead = max([o for _, o in columns.values() if o > 0], default=0)
    home = block_of(F.col(index), size)
    place = F.pmod(F.col(index).cast("long"), F.lit(size))
    targets = [home]
    if back:
        targets.append(F.when(place >= size - back, home + 1))
    if ahead:
        targets.append(F.when(place < ahead, home - 1))
    copies = df.withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
    w = Window.partitionBy(*keys, "_block").orderBy(index)
    out = copies
    for name, (source, offset) in columns.items():
        moved = F.lag(source, -offset) if offset < 0 else F.lead(source, offset)
        out = out.withColumn(name, moved.over(w))
    return out.where(F.col("_block") == block_of(F.col(index), size)).drop("_block")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    columns: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running values along `order` in each key: `{new_column: (kind, expression)}`.

    Kinds: `sum` up to and including the row, `last` non-null value up to and including
    the row, `next` non-null value from the row on, `max` up to and including the row,
    `prev` non-null value of the row before (for orders that are not dense).
    """
    keys, order = list(keys), list(order)
    df = df.withColumn("_block", block)
    group = [*keys, "_block"]
    ordered = Window.partitionBy(*group).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    across = Window.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)

    inside, totals, carried, combined = {}, [], {}, {}
    place = F.struct(*order)
    for name, (kind, expr) in columns.items():
        here, total, carry = f"_in_{name}", f"_tot_{name}", f"_off_{name}"
        marked = F.when(expr.isNotNull(), place)
        if kind == "sum":
            inside[here] = F.sum(expr).over(upto)
            totals.append(F.sum(expr).alias(total))
            carried[carry] = F.sum(total).over(before)
            combined[name] = F.coalesce(F.col(carry) + F.col(here), F.col(here), F.col(carry))
        elif kind == "max":
            inside[here] = F.max(expr).over(upto)
            totals.append(F.max(expr).alias(total))
            carried[carry] = F.max(total).over(before)
            combined[name] = F.greatest(F.col(carry), F.col(here))
        elif kind == "last":
            inside[here] = F.last(expr, ignorenulls=True).over(upto)
            totals.append(F.max_by(expr, marked).alias(total))
            carried[carry] = F.last(total, ignorenulls=True).over(before)
            combined[name] = F.coalesce(F.col(here), F.col(carry))
        elif kind == "next":
            inside[here] = F.first(expr, ignorenulls=True).over(onward)
            totals.append(F.min_by(expr, marked).alias(total))
            carried[carry] = F.first(total, ignorenulls=True).over(after)
            combined[name] = F.coalesce(F.col(here), F.col(carry))
        elif kind == "prev":
            inside[here] = F.lag(expr).over(ordered)
            totals.append(F.max_by(expr, marked).alias(total))
            carried[carry] = F.last(total, ignorenulls=True).over(before)
            combined[name] = F.coalesce(F.col(here), F.col(carry))
        else:
            raise ValueError(f"unknown running kind: {kind}")

    summary = df.groupBy(*group).agg(*totals)
    offsets = summary.select(*group, *[c.alias(n) for n, c in carried.items()])
    local = df.select("*", *[c.alias(n) for n, c in inside.items()])
    # the windows have dealt out and sorted `local` already; with many short keys `offsets` is too long for the driver
    joined = local.hint("merge").join(offsets, group, "left")
    helpers = ["_block", *inside, *carried]
    return joined.withColumns(combined).drop(*helpers)


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str
) -> DataFrame:
    """0-based position of the row in its key, as an int."""
    counted = running(df, keys, order, block, {"_n": ("sum", F.lit(1).cast("long"))})
    return counted.withColumn(out, (F.col("_n") - 1).cast("int")).drop("_n")


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank",
    spread: Sequence[str] = (), salts: int = 64,
) -> DataFrame:
    """First `n` rows of every key, exactly: first inside `salts` slices of the key, then overall.

    `spread` names the columns that tell the rows of a key apart; they pick the slice.
    The last step sees at most `salts * n` rows of a key, whatever the key holds.
    """
    keys = list(keys)
    if spread:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        sliced = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(sliced)).where(F.col("_r") <= n).drop("_r", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)


def joined_text(order: Sequence[str], text: Column | str, sep: str) -> Column:
    """Aggregate: texts of a bounded group in order, joined by `sep` (nulls skipped)."""
    text = F.col(text) if isinstance(text, str) else text
    items = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_t")))))
    return F.array_join(F.transform(items, lambda x: x["_t"]), sep)
