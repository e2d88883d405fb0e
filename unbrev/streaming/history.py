"""Acceptance counters on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unbrev.plans.history import history_from_log
from unbrev.profile import Profile


def stream_history(
    log: DataFrame, profile: Profile, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Keep running counters of a streamed log.

    Each micro-batch writes the pairs it changed, with their totals so far, to
    its own folder; :func:`latest_history` reads the current state.  A batch
    that runs again overwrites its own folder, so nothing is counted twice.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        history_from_log(log, profile)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_history(changes: DataFrame) -> DataFrame:
    """Current counters from the written changes (counts only ever grow)."""
    return changes.groupBy("user_id", "skeleton", "form").agg(
        F.max("confirmed").alias("confirmed"), F.max("reverted").alias("reverted")
    )


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming plan over all data there is now, into a parquet table."""
    query = (
        rows.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
