"""Session settings the jobs benefit from."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: str | None = None

# Large enough for the default cap per source, so that ranking windows drop
# rows inside the map tasks.
GROUP_LIMIT = 4096
ARROW_ROWS = 20_000


def tune(spark: SparkSession) -> SparkSession:
    """Set the few runtime options that change plans of these jobs.

    All of them are session-level SQL options; sizes of executors, shuffles and
    input splits stay with the cluster.
    """
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": str(GROUP_LIMIT),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in options.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that jobs write and read back.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may do
    without, and gets a temporary folder; anywhere else executors would each write to
    a disk of their own, so an unset folder is an error.
    """
    global _LOCAL_FOLDER
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _LOCAL_FOLDER is None:
        _LOCAL_FOLDER = tempfile.mkdtemp(prefix="unbrev-")
    return _LOCAL_FOLDER


def settle(rows: DataFrame) -> DataFrame:
    """Write rows once and read them back.

    For results that several branches of a job use and that are dear to work
    out: every branch would repeat the work, and a lost executor too.  Runs a
    Spark job.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/unbrev-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
