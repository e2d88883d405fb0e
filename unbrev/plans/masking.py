"""Masked twins of ranked forms, tied to the tone of the session where that is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unbrev.operators.blocked import running_max
from unbrev.plans.expand import mask_active, with_masked_twins
from unbrev.plans.sessions import BLOCK
from unbrev.profile import Profile

NEUTRAL = "neutral"


def register_as_of(track: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks (session_id, tick, ...)`` with the ``register`` of their session then.

    ``track (session_id, pos, tick, register)`` is a
    :func:`unbrev.plans.sessions.session_features` table.  The last word at or before the
    ask's tick counts, whether plain or not; a session without words so far is neutral.
    Words and asks are merged into one ordered stream per session and block, so nothing
    is paired up.
    """
    keys = ["session_id", "tick"]
    words = track.select(*keys, "pos", F.col("pos").alias("seen"), F.lit(0).alias("probe"))
    times = asks.select(*keys).distinct()
    probes = times.select(
        *keys,
        F.lit(None).cast("bigint").alias("pos"),
        F.lit(None).cast("bigint").alias("seen"),
        F.lit(1).alias("probe"),
    )
    merged = running_max(
        words.unionByName(probes),
        ["session_id"],
        [F.floor(F.col("tick") / BLOCK)],
        [F.col("tick"), F.col("probe"), F.col("pos")],
        F.col("seen"),
        "last_pos",
    )
    at = track.select("session_id", F.col("pos").alias("last_pos"), "register")
    found = (
        merged.filter(F.col("probe") == 1)
        .select(*keys, "last_pos")
        .join(at, ["session_id", "last_pos"], "left")
        .select(*keys, F.coalesce("register", F.lit(NEUTRAL)).alias("register"))
    )
    return asks.join(found, keys)


def mask_expansions(
    rows: DataFrame,
    mask_lemmas: DataFrame,
    profile: Profile,
    limit: int,
    registers: DataFrame | None = None,
    when_polite: bool = False,
    grouped: bool = False,
) -> DataFrame:
    """Ranked ``rows`` with masked twins (:func:`with_masked_twins`).

    With ``when_polite`` only queries that ``registers (query_id, register)`` calls
    polite get twins; a query that it lacks is neutral.  Without registers there is no
    tone to read, and all get them.  ``grouped`` rows are one per lemma: a twin is a
    group of its own right after the group it masks.
    """
    if registers is None:
        return with_masked_twins(rows, mask_lemmas, profile, limit, None, grouped)
    toned = rows.join(registers.select("query_id", "register"), "query_id", "left").withColumn(
        "register", F.coalesce("register", F.lit(NEUTRAL))
    )
    active = mask_active(F.lit(True), when_polite, F.col("register"))
    return with_masked_twins(toned, mask_lemmas, profile, limit, active, grouped)
