"""Shape and order of lexicon tables.

A lexicon has the columns ``form_id, form, lemma, freq, tags``.  ``form_id`` is
the load position of a row read from a file, and 0 in derived lexicons, whose
order is that of the written artifact: frequency falling, then form.
:func:`in_load_order` gives several sources one numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.functions import text as tx
from unbrev.profile import Profile
from unbrev.session import settle

LEXICON_COLUMNS = ["form_id", "form", "lemma", "freq", "tags"]
_BLOCK_ROWS = 4096


def with_keys(lexicon: DataFrame, profile: Profile) -> DataFrame:
    """Add the matching keys ``norm`` and ``skel``."""
    norm = tx.normalize(F.col("form"), profile)
    return lexicon.withColumn("norm", norm).withColumn(
        "skel", tx.skeleton(F.col("norm"), profile)
    )


def by_frequency() -> list[Column]:
    """Total order of lexicon rows, most frequent first."""
    return [F.desc("freq"), F.col("form_id"), F.col("form"), F.col("lemma")]


def lexicon_order(prefix: str = "") -> list[Column]:
    """Load order of lexicon rows (see the module text)."""
    return [
        F.col(f"{prefix}form_id"),
        -F.col(f"{prefix}freq"),
        F.col(f"{prefix}form"),
    ]


def lexicon_block(prefix: str = "") -> list[Column]:
    """Coarse steps of :func:`lexicon_order`, for block-wise numbering."""
    position = F.col(f"{prefix}form_id")
    derived = position == 0
    return [
        F.floor(position / _BLOCK_ROWS),
        F.when(derived, -F.col(f"{prefix}freq")).otherwise(F.lit(0.0)),
        F.when(derived, F.left(F.col(f"{prefix}form"), F.lit(2))).otherwise(""),
    ]


_ROW_BITS = 33


def in_load_order(*sources: DataFrame) -> DataFrame:
    """The sources one after the other as one lexicon, numbered from 1 without gaps.

    Within a source rows keep their order (:func:`lexicon_order`, then lemma and tags).
    A range-partitioned sort places every row within its partition; the partitions' sizes,
    summed up, give its number.  Nothing but these sizes is in one task.  Runs a job.
    """
    parts = [s.select(*LEXICON_COLUMNS, F.lit(n).alias("_source")) for n, s in enumerate(sources)]
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more)
    order = [F.col("_source"), *lexicon_order(), F.col("lemma"), F.col("tags")]
    placed = settle(
        merged.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before)
    at = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.coalesce("_before", F.lit(0)) + 1
    return (
        placed.join(sizes, "_part")
        .withColumn("form_id", at)
        .select(*LEXICON_COLUMNS)
    )


def vocabulary(lexicon: DataFrame, profile: Profile) -> DataFrame:
    """One row per normalised form, with the order key of its first entry."""
    first = F.min(F.struct("form_id", (-F.col("freq")).alias("neg"), "form"))
    return (
        with_keys(lexicon, profile)
        .groupBy("norm")
        .agg(first.alias("o"))
        .select(
            "norm",
            F.col("o.form_id").alias("form_id"),
            (-F.col("o.neg")).alias("freq"),
        )
    )
