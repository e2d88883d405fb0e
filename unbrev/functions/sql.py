"""Scalar functions for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from unbrev.functions.distance import distance_udf
from unbrev.profile import Profile


def register_functions(spark: SparkSession, profile: Profile, prefix: str = "") -> None:
    """Register normalize, skeleton, delete_variants, edit_distance, mask_form."""
    silent = profile.vowels + profile.signs
    fold = f"translate(lower(s), '{profile.fold_from}', '{profile.fold_to}')"
    bodies = {
        "word_normalize(s STRING) RETURNS STRING": fold,
        "word_skeleton(s STRING) RETURNS STRING": f"translate(s, '{silent}', '')",
        "word_deletes(s STRING) RETURNS ARRAY<STRING>": (
            "CASE WHEN length(s) >= 3 THEN array_distinct(transform("
            "sequence(1, length(s)), i -> concat(left(s, i - 1), substr(s, i + 1))))"
            " ELSE CAST(array() AS ARRAY<STRING>) END"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURN {body}"
        )
    spark.udf.register(f"{prefix}word_distance", distance_udf(profile))
