"""Signals that a caller's table or function gives: government rules, context scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.functions import text as tx
from unbrev.profile import Profile

#: Score of each row from its contexts (lists of words), forms and lemmas.
BatchScore = Callable[[pa.Array, pa.Array, pa.Array], np.ndarray]


def government_rules(spark: SparkSession, profile: Profile) -> DataFrame:
    """The profile's rules as a table ``(prep, case)``."""
    rows = [(prep, case) for prep, cases in profile.government.items() for case in cases]
    return spark.createDataFrame(rows, "prep string, case string")


def with_government(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``s_morph``: 1 where a rule ``(prep, case)`` has the word before and the case
    of the candidate's tags, else 0; never negative, so it can only help."""
    known = rules.select(
        F.col("prep").alias("prev_word"), F.col("case").alias("_case"), F.lit(1.0).alias("_fits")
    ).distinct()
    return (
        rows.withColumn("_case", tx.grammatical_case(F.col("tags")))
        .join(known, ["prev_word", "_case"], "left")
        .withColumn("s_morph", F.coalesce("_fits", F.lit(0.0)))
        .drop("_case", "_fits")
    )


def batch_scorer(score: BatchScore) -> Callable[[DataFrame], DataFrame]:
    """A ``context_scorer`` of :class:`unbrev.plans.expand.Knowledge` from a function over
    Arrow batches.

    Each distinct (context, form, lemma) is scored once, in the tasks; candidates then
    look their score up.  Scores that are not finite count as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.asarray(score(batch.column("_ctx"), batch.column("_form"), batch.column("_lemma")), float)
            column = pa.array(np.where(np.isfinite(value), value, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "s_context"])

    def attach(rows: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        context = F.coalesce("context", none) if "context" in rows.columns else none
        asked = rows.withColumn("_ctx", context)
        scored = (
            asked.select("_ctx", F.col("form").alias("_form"), F.col("lemma").alias("_lemma"))
            .distinct()
            .mapInArrow(run, "_ctx array<string>, _form string, _lemma string, s_context double")
        )
        same = (
            F.col("_ctx").eqNullSafe(F.col("_of"))
            & F.col("form").eqNullSafe(F.col("_form"))
            & F.col("lemma").eqNullSafe(F.col("_lemma"))
        )
        return asked.join(scored.withColumnRenamed("_ctx", "_of"), same, "left").drop(
            "_ctx", "_of", "_form", "_lemma"
        )

    return attach
