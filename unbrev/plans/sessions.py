"""Per-session features of a word stream: ticks, recency, tone, register.

Sessions are numbered by change of context; within one, time is the number of
words seen.  Long sessions are worked block by block, so none of these jobs
puts a whole session into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.functions import scoring as sc
from unbrev.functions import text as tx
from unbrev.operators.blocked import neighbour, running_max, running_total
from unbrev.profile import Profile
from unbrev.session import settle
from unbrev.settings import RECENCY_HALF_LIFE, TONE_HALF_LIFE

BLOCK = 4096
# Past this many half-lives a marker weighs less than rounding does.
_FADED_HALF_LIVES = 64


def number_sessions(
    events: DataFrame,
    user: str,
    order: Sequence[str],
    context: str,
    block: Column,
    out: str = "session_no",
) -> DataFrame:
    """Number a user's sessions from 1; a new context starts a new session.

    A missing user, block or context is a value of its own, so no row is lost and
    rows without context that follow each other are one session.
    """
    context_of = F.struct(F.col(context).alias("c"))
    prev = neighbour(events, [user], [block], order, context_of, "_prev")
    changed = ~F.col("_prev.c").eqNullSafe(F.col(context))
    first = F.col("_prev").isNull()
    step = F.when(first | changed, 1).otherwise(0).cast("bigint")
    return running_total(
        prev, [user], [block], [F.col(c) for c in order], step, out
    ).drop("_prev")


def session_ticks(
    words: DataFrame,
    profile: Profile,
    session: str = "session_id",
    pos: str = "pos",
    word: str = "word",
) -> DataFrame:
    """Number the plain words of each session.

    Adds ``norm``, ``display``, ``is_plain`` and ``tick``, the number of plain
    words up to and including this one.  ``pos`` counts words from any start.
    """
    display = tx.strip(F.col(word))
    keyed = words.withColumn("display", display).withColumn(
        "norm", tx.normalize(F.col("display"), profile)
    )
    plain = (F.col("norm") != "") & tx.is_plain_word(F.col("norm"), profile)
    flagged = keyed.withColumn("is_plain", plain)
    return running_total(
        flagged,
        [session],
        [F.floor(F.col(pos) / BLOCK)],
        [F.col(pos)],
        F.col("is_plain").cast("bigint"),
        "tick",
    )


def last_seen_before(
    ticked: DataFrame, session: str = "session_id", half_life: float = RECENCY_HALF_LIFE
) -> DataFrame:
    """For each plain word: when it was last used before, and the recency prior
    it had just before this use (0 for a first use)."""
    plain = ticked.filter("is_plain")
    seen = neighbour(
        plain,
        [session, "norm"],
        [F.floor(F.col("tick") / BLOCK)],
        ["tick"],
        F.col("tick"),
        "last_tick",
    )
    prior = sc.recency_prior(F.col("tick") - 1, F.col("last_tick"), half_life)
    return seen.withColumn("recency", prior)


def last_seen_as_of(
    ticked: DataFrame,
    probes: DataFrame,
    session: str = "session_id",
    half_life: float = RECENCY_HALF_LIFE,
) -> DataFrame:
    """As-of lookup: for each probe ``(session, norm, tick)`` the last use of
    the word at or before that tick, as ``last_tick`` and ``recency``.

    Uses and probes are merged into one ordered stream per word; nothing is
    paired up.  Probes of words that the session never used drop out first.
    """
    keys = [session, "norm"]
    uses = ticked.filter("is_plain").select(*keys, "tick", F.col("tick").alias("seen"))
    asked = (
        probes.select(*keys, "tick")
        .distinct()
        .join(uses.select(*keys).distinct(), keys, "left_semi")
        .withColumn("seen", F.lit(None).cast("bigint"))
    )
    merged = uses.withColumn("probe", F.lit(0)).unionByName(
        asked.withColumn("probe", F.lit(1))
    )
    filled = running_max(
        merged,
        keys,
        [F.floor(F.col("tick") / BLOCK)],
        [F.col("tick"), F.col("probe")],
        F.col("seen"),
        "last_tick",
    )
    return (
        filled.filter((F.col("probe") == 1) & F.col("last_tick").isNotNull())
        .select(*keys, "tick", "last_tick")
        .withColumn("recency", sc.recency_prior(F.col("tick"), F.col("last_tick"), half_life))
    )


def tone_track(
    words: DataFrame,
    markers: DataFrame,
    profile: Profile,
    session: str = "session_id",
    pos: str = "pos",
    word: str = "word",
    half_life: float = TONE_HALF_LIFE,
) -> DataFrame:
    """Decayed tone sums after each word: ``tone_score, tone_mass, register``.

    Every word ages the sums, plain or not; ``pos`` must count the words of a
    session without gaps.  Inside a block the decayed sum is a running sum of
    growing weights, scaled back at each row; the sums at the end of the block
    before come in decayed, and anything older has faded below rounding.
    """
    block = max(1, math.ceil(_FADED_HALF_LIVES * half_life))
    marks = markers.select(
        F.col("word").alias("norm"), F.col("sign").cast("double").alias("sign")
    )
    marked = (
        words.withColumn("norm", tx.normalize(F.col(word), profile))
        .join(marks, "norm", "left")
        .drop("norm")
        .withColumn("_block", F.floor(F.col(pos) / block))
        .withColumn("_off", F.col(pos) - F.col("_block") * block)
    )
    grown = F.pow(F.lit(2.0), F.col("_off") / half_life)
    hit = F.col("sign").isNotNull().cast("double")
    weighted = marked.withColumns(
        {
            "_ws": F.coalesce(F.col("sign"), F.lit(0.0)) * grown,
            "_wm": hit * grown,
        }
    )
    carried = (
        weighted.groupBy(session, "_block")
        .agg(F.sum("_ws").alias("_cs"), F.sum("_wm").alias("_cm"))
        .select(
            session,
            (F.col("_block") + 1).alias("_block"),
            *[
                (F.col(c) * 2.0 ** (-block / half_life)).alias(c)
                for c in ("_cs", "_cm")
            ],
        )
    )
    inside = (
        Window.partitionBy(session, "_block")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    scale = F.pow(F.lit(0.5), F.col("_off") / half_life)

    def total(local: str, carry: str) -> Column:
        return (F.sum(local).over(inside) + F.coalesce(F.col(carry), F.lit(0.0))) * scale

    return (
        weighted.join(carried, [session, "_block"], "left")
        .withColumns({"tone_score": total("_ws", "_cs"), "tone_mass": total("_wm", "_cm")})
        .withColumn("register", sc.register(F.col("tone_score"), F.col("tone_mass")))
        .drop("sign", "_block", "_off", "_ws", "_wm", "_cs", "_cm")
    )


def session_features(
    words: DataFrame,
    markers: DataFrame,
    profile: Profile,
    recency_half_life: float = RECENCY_HALF_LIFE,
    tone_half_life: float = TONE_HALF_LIFE,
) -> DataFrame:
    """Both feature tracks of a ``(session_id, pos, word)`` stream.

    ``pos`` is different for each word of a session; words without a session have no
    earlier use.
    """
    toned = tone_track(words, markers, profile, half_life=tone_half_life)
    ticked = settle(session_ticks(toned, profile))
    placed = F.col("session_id").isNotNull() & F.col("pos").isNotNull()
    looked_up = F.col("is_plain") & placed
    # The words looked up come back whole and the others join them, so nothing is joined
    # to its own rows again.
    seen = last_seen_before(ticked.filter(looked_up), half_life=recency_half_life)
    rest = ticked.filter(~F.coalesce(looked_up, F.lit(False))).withColumns(
        {"last_tick": F.lit(None).cast("bigint"), "recency": F.lit(None).cast("double")}
    )
    return seen.unionByName(rest)
