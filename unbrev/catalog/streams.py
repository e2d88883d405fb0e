"""Registered queries that run as streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import history, sessions
from unbrev.catalog.inputs import P, table
from unbrev.functions import text as tx
from unbrev.session import shared_folder
from unbrev.streaming import history as sh
from unbrev.streaming import sessions as st


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(sf_dir)
    )


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _in_files(rows: DataFrame, order: Column, bounds: list, files: int = 1) -> DataFrame:
    """The rows as a stream of several parts, in rising ``order``, a part of ``files`` files
    at most and so many files a trigger.

    ``bounds`` are the least values of the second, third, ... part.  Where a part has fewer
    files, its trigger takes some of the next part too: with several files, what belongs
    together must be in one file of each part.
    """
    spark, folder = rows.sparkSession, f"{_folder(rows.sparkSession)}/in"
    edges = [None, *bounds, None]
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        kept = F.lit(True) if low is None else order >= F.lit(low)
        kept = kept if high is None else kept & (order < F.lit(high))
        rows.filter(kept).write.parquet(f"{folder}/part={number}")
    return (
        spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", files)
        .option("recursiveFileLookup", "true")
        .parquet(folder)
    )


#: Turns of conversations that come as one part each; later ones share the last.
TURN_FILES = 4


def stream_session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of conversations that come turn by turn, over several triggers."""
    st.use_state_store(spark)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # A conversation is in one file of each part, so its turns stay in order.
    given = given.repartition(files, "conv_id")
    turns = _in_files(given, F.coalesce("turn", F.lit(0)), list(range(1, TURN_FILES)), files)
    words = turns.select(
        F.col("conv_id").alias("session_id"),
        "turn",
        F.posexplode(tx.words_in(F.col("text"), P)).alias("p", "word"),
    ).select("session_id", (F.col("turn") * 1_000_000_000 + F.col("p")).alias("pos"), "word")
    # The table ends, so nothing need be forgotten.
    rows = st.stream_session_features(words, sessions.markers(spark), P, keep_ms=None, groups=32 * files)
    folder = _folder(spark)
    sh.run_to_table(rows, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select(
        "session_id", "pos", "norm", "tick", F.round("recency", 6).alias("recency"), "register", "late"
    )


#: A pick without an undo for so long is confirmed; events may come so much too late.
CONFIRM_MS, DELAY = 6 * 3_600_000, "1 hour"


def stream_pending_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of picks that come day by day, the last ones confirmed by the timer."""
    st.use_state_store(spark)
    kind = (
        F.when(F.col("event_type") == "click", "pick")
        .when(F.col("event_type") == "error", "undo")
        .otherwise("type")
    )
    given = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kind.alias("kind")
    ).coalesce(1)
    low, high = given.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    seconds = F.coalesce(F.unix_seconds("ts"), F.lit(low))
    bounds = [] if low is None else [low + (high - low) * k // 5 for k in range(1, 5)]
    events = _in_files(given, seconds, bounds)
    folder = _folder(spark)
    sh.run_to_table(st.stream_resolve_picks(events, CONFIRM_MS, DELAY), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def stream_history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    log = history.log_rows(_stream(spark, sf_dir, "events"))
    sh.stream_history(log, P, f"{folder}/out", f"{folder}/state").awaitTermination()
    changes = spark.read.parquet(f"{folder}/out").drop("batch")
    return sh.latest_history(changes)


SQL = {
    "stream_session_features": "SELECT *, false AS late FROM (" + sessions.SQL["session_features"] + ")",
    # The timer fires for picks whose time is past before the newest event less the delay.
    "stream_pending_confirm": f"""
SELECT event_id, user_id, CASE WHEN nxt = 'error' AND nms <= ms + {CONFIRM_MS} THEN 'reverted' ELSE 'confirmed' END AS status,
  least(coalesce(nms, ms + {CONFIRM_MS}), ms + {CONFIRM_MS}) AS resolved_ms
FROM (
  SELECT *, lead(event_type) OVER w AS nxt, lead(ms) OVER w AS nms, max(ms) OVER () AS newest
  FROM (SELECT event_id, ts, user_id::VARCHAR AS user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
) WHERE event_type = 'click' AND (nxt IS NOT NULL OR ms + {CONFIRM_MS} <= newest - 3600000)""",
    "stream_history_counts": history.SQL["history_counts"],
}
RUN = {name: globals()[name] for name in SQL}
