"""Running values over long ordered groups, worked out block by block.

A window over a whole group runs in one task.  Where a group (a session, a
user, or the whole table) can be very long, these operators cut it into blocks
by a column that agrees with the order, run the window inside each block, and
add what comes in from the blocks before it.  Only one row per block is ever
ordered over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column]


def _block_columns(df: DataFrame, block: Order) -> tuple[DataFrame, list[str]]:
    names = [f"_b{i}" for i in range(len(block))]
    return df.withColumns(dict(zip(names, block))), names


def _attach(df: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the columns of ``found``, one row per block, to the rows of the block.

    A null key or block is a value like any other.
    """
    right = found.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(right, reduce(and_, same)).drop(*[f"_on_{c}" for c in on])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    block: Order,
    order: Order,
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group up to this row."""
    df, names = _block_columns(df.withColumn("_v", value), block)
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*names)
    before = (
        df.groupBy(*keys, *names)
        .agg(F.sum("_v").alias("_t"))
        .withColumn(
            "_before",
            F.sum("_t").over(across.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .drop("_t")
    )
    local = F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        _attach(df.withColumn("_local", local), before, [*keys, *names])
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_v", "_local", "_before", *names)
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], block: Order, order: Order, out: str
) -> DataFrame:
    """Add ``out``: the position of the row in its group, from 1."""
    return running_total(df, keys, block, order, F.lit(1).cast("bigint"), out)


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    block: Order,
    order: Order,
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the largest ``value`` of the group up to this row.

    With a value that grows along the order this is the last non-null value,
    which makes it the as-of lookup of a merged stream of events and probes.
    """
    df, names = _block_columns(df.withColumn("_v", value), block)
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*names)
    before = (
        df.groupBy(*keys, *names)
        .agg(F.max("_v").alias("_t"))
        .withColumn(
            "_before",
            F.max("_t").over(across.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .drop("_t")
    )
    local = F.max("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        _attach(df.withColumn("_local", local), before, [*keys, *names])
        .withColumn(out, F.greatest(F.col("_local"), F.col("_before")))
        .drop("_v", "_local", "_before", *names)
    )


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    block: Order,
    order: Sequence[str],
    value: Column,
    out: str,
    following: bool = False,
) -> DataFrame:
    """Add ``out``: ``value`` of the row before (or after) this one."""
    df, names = _block_columns(df.withColumn("_v", F.struct(value.alias("v"))), block)
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*names)
    key = F.struct(*order)
    if following:
        edge, shift = F.min_by("_v", key), F.lead
    else:
        edge, shift = F.max_by("_v", key), F.lag
    carried = (
        df.groupBy(*keys, *names)
        .agg(edge.alias("_edge"))
        .withColumn("_carry", shift("_edge").over(across))
        .drop("_edge")
    )
    return (
        _attach(df.withColumn("_local", shift("_v").over(inside)), carried, [*keys, *names])
        .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry"))["v"])
        .drop("_v", "_local", "_carry", *names)
    )


def top_k(
    df: DataFrame, k: int, measure: str, block: Order, order: Order
) -> DataFrame:
    """The ``k`` first rows by ``measure`` descending, then ``order``.

    The histogram of the measure gives the lowest value that can be needed;
    rows below it are dropped before anything is ordered.  ``measure`` must be
    a count-like column, so that the histogram is far smaller than the table.
    """
    falling = Window.orderBy(F.desc(measure))
    cut = (
        df.groupBy(measure)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_above",
            F.sum("_n").over(falling.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .filter(F.coalesce(F.col("_above"), F.lit(0)) < k)
        .agg(F.min(measure).alias("_cut"))
    )
    kept = df.filter(F.col(measure) >= cut.scalar())
    fall = -F.col(measure)
    return (
        row_numbers(kept, [], [fall, *block], [fall, *order], "_rn")
        .filter(F.col("_rn") <= k)
        .drop("_rn")
    )
