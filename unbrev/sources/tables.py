"""Reading given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small(rows: DataFrame) -> DataFrame:
    """Spread rows over all cores if the files give fewer splits than that.

    Splitting text into words is heavy per byte, and a small file with one row
    group is one split.  Large inputs have more splits than cores and are
    returned as they are, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
