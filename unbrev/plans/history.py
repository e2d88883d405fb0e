"""Acceptance history: from picks and undos to counters and ranking priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unbrev.functions import scoring as sc
from unbrev.functions import text as tx
from unbrev.operators.blocked import neighbour, running_total
from unbrev.profile import Profile

CONFIRMED, REVERTED = "confirmed", "reverted"
# When a pair becomes an exception.
EXCEPTION_REVERTS = 3
EXCEPTION_DAYS = 7
EXCEPTION_RATE = 0.5
EXCEPTION_MIN_TAPS = 5


def resolve_picks(
    events: DataFrame,
    user: str,
    order: Sequence[str],
    block: Column,
    kind: str = "kind",
) -> DataFrame:
    """Give each ``pick`` its outcome: reverted when the user's very next event
    is an ``undo``, else confirmed (another pick, typing on, or the end)."""
    followed = neighbour(
        events, [user], [block], order, F.col(kind), "_next", following=True
    )
    undone = F.coalesce(F.col("_next") == "undo", F.lit(False))
    return (
        followed.filter(F.col(kind) == "pick")
        .withColumn("status", F.when(undone, REVERTED).otherwise(CONFIRMED))
        .drop("_next")
    )


def history_from_log(log: DataFrame, profile: Profile) -> DataFrame:
    """Counters ``(user_id, skeleton, form, confirmed, reverted)`` of a log with
    ``user_id, status, shorthand, form``."""
    typed = tx.normalize(tx.strip(F.col("shorthand")), profile)
    return log.groupBy(
        "user_id",
        tx.skeleton(typed, profile).alias("skeleton"),
        tx.normalize(F.col("form"), profile).alias("form"),
    ).agg(
        F.count_if(F.col("status") == CONFIRMED).alias("confirmed"),
        F.count_if(F.col("status") == REVERTED).alias("reverted"),
    )


def merge_histories(*histories: DataFrame) -> DataFrame:
    """Sum the counters of several histories."""
    merged = histories[0]
    for other in histories[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("user_id", "skeleton", "form").agg(
        F.sum("confirmed").alias("confirmed"), F.sum("reverted").alias("reverted")
    )


def form_popularity(history: DataFrame) -> DataFrame:
    """Confirmed uses per user and form, over all shorthands."""
    return (
        history.groupBy("user_id", "form")
        .agg(F.sum("confirmed").alias("form_count"))
        .filter(F.col("form_count") > 0)
    )


def history_priors(history: DataFrame) -> DataFrame:
    """Ranking prior of every counted pair."""
    prior = sc.history_prior(F.col("confirmed"), F.col("reverted"), F.col("form_count"))
    return history.join(form_popularity(history), ["user_id", "form"], "left").select(
        "user_id", "skeleton", "form", prior.alias("prior")
    )


def acceptance_quality(log: DataFrame, pair: Sequence[str] = ("shorthand", "form")) -> DataFrame:
    """Taps, confirmed and reverted counts and their rates per pair."""
    taps = F.greatest(F.col("tapped"), F.lit(1))
    return (
        log.groupBy(*pair)
        .agg(
            F.count_if(F.col("status").isin(CONFIRMED, REVERTED)).alias("tapped"),
            F.count_if(F.col("status") == CONFIRMED).alias("confirmed"),
            F.count_if(F.col("status") == REVERTED).alias("reverted"),
        )
        .withColumn("accept_quality", F.col("confirmed") / taps)
        .withColumn("rejection_rate", F.col("reverted") / taps)
    )


def earned_exceptions(
    log: DataFrame, pair: Sequence[str] = ("shorthand", "form"), ts: str = "ts"
) -> DataFrame:
    """Pairs that users keep undoing: three reverts within seven days, or more
    than half of at least five taps.
    """
    quality = acceptance_quality(log, pair)
    rate_hit = (F.col("tapped") >= EXCEPTION_MIN_TAPS) & (
        F.col("rejection_rate") > EXCEPTION_RATE
    )
    bursts = _reverts_in_days(log, pair, ts)
    burst_hit = F.coalesce(F.col("most_reverts"), F.lit(0)) >= EXCEPTION_REVERTS
    return (
        quality.join(bursts, list(pair), "left")
        .filter(rate_hit | burst_hit)
        .select(
            *pair,
            "tapped",
            "reverted",
            "rejection_rate",
            F.coalesce("most_reverts", F.lit(0)).cast("bigint").alias("most_reverts"),
        )
    )


def _reverts_in_days(log: DataFrame, pair: Sequence[str], ts: str) -> DataFrame:
    """Most reverts of a pair in any seven days that end with a revert.

    That is the number of reverts up to the last one less the number before the
    first of the seven days.  Both come from one running count, worked block by
    block, in which each revert asks twice.
    """
    span, hour = EXCEPTION_DAYS * 86_400_000_000, 3_600_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    reverts = (
        log.filter(F.col("status") == REVERTED)
        .groupBy(*pair, at.alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def row(when: Column, turn: int, n: Column) -> Column:
        return F.struct(when.alias("when"), F.lit(turn).alias("turn"), n.alias("n"))

    # At one time: first the question about earlier reverts, then the reverts
    # themselves, then the question about all so far.
    before, own, upto = 0, 1, 2
    none = F.lit(0).cast("bigint")
    stream = reverts.select(
        *pair,
        "at",
        F.explode(
            F.array(
                row(F.col("at") - span, before, none),
                row(F.col("at"), own, F.col("n")),
                row(F.col("at"), upto, none),
            )
        ).alias("r"),
    ).select(*pair, "at", "r.*")
    counted = running_total(
        stream,
        list(pair),
        [F.floor(F.col("when") / hour)],
        [F.col("when"), F.col("turn")],
        F.col("n"),
        "so_far",
    )
    inside = F.max(F.when(F.col("turn") == upto, F.col("so_far"))) - F.max(
        F.when(F.col("turn") == before, F.col("so_far"))
    )
    return (
        counted.groupBy(*pair, "at")
        .agg(inside.alias("inside"))
        .groupBy(*pair)
        .agg(F.max("inside").alias("most_reverts"))
    )
