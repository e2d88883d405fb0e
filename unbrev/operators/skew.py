"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unbrev.session import settle

# Joined rows that one task should make at most.
SLICE_ROWS = 1_000_000


def hot_keys(
    left: DataFrame, right: DataFrame, on: Sequence[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Keys that make more than ``slice_rows`` joined rows, and in how many slices.

    A key gets no more slices than it has rows on the left.
    """
    sizes = [
        side.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
        for side, name in ((left, "_left"), (right, "_right"))
    ]
    made = F.col("_left") * F.col("_right")
    slices = F.least(F.ceil(made / slice_rows), F.col("_left")).cast("int")
    return (
        sizes[0].join(sizes[1], list(on)).filter(made > slice_rows).select(*on, slices.alias("_slices"))
    )


def sliced_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    slice_rows: int = SLICE_ROWS,
    left_settled: bool = False,
    right_settled: bool = False,
) -> DataFrame:
    """Equi-join for a many-rows ``left`` and few-rows-per-key ``right``.

    Rows of a hot key on the left are spread over slices by the hash of the
    ``spread`` columns, and the right rows of that key are repeated once per
    slice.  Results equal those of a plain join.  What a slice makes is about
    ``slice_rows`` rows, whichever side they come from, as long as no value of the
    ``spread`` columns is hot itself; the size-based skew handling of the adaptive
    planner does not see output.

    Both sides are settled (unless they are so already), since counting keys and
    joining would each work them out again; counting reads the keys only.  There are at most as many hot keys as
    ``slice_rows`` goes into the joined rows; their list is settled too, so the planner
    joins it knowing its size, and where there are none nothing is joined.  The join
    itself deals both sides out by key, however small they are, for what it makes is large.
    """
    left = left if left_settled else settle(left)
    right = right if right_settled else settle(right)
    hot = settle(hot_keys(left, right, on, slice_rows))
    if hot.isEmpty():
        return left.join(right.hint("merge"), list(on), how)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    left_sliced = (
        left.join(hot, list(on), "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread), slices).cast("int"))
        .drop("_slices")
    )
    right_sliced = (
        right.join(hot, list(on), "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return left_sliced.join(right_sliced.hint("merge"), [*on, "_slice"], how).drop("_slice")
