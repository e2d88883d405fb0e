"""Keyed postings of a lexicon: which forms can be reached from which key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.functions import text as tx
from unbrev.operators.lexicons import LEXICON_COLUMNS, by_frequency, with_keys
from unbrev.profile import Profile
from unbrev.session import settle
from unbrev.settings import Settings

# Kinds of key.
SKELETON = "skel"
SKELETON_PREFIX = "skel_prefix"
FORM_PREFIX = "form_prefix"
ENDING = "ending"
SKELETON_DELETE = "skel_delete"
KINDS = (SKELETON, SKELETON_PREFIX, FORM_PREFIX, ENDING, SKELETON_DELETE)

# Prefixes up to this length may belong to a large share of all forms; such keys are
# ranked in slices first.
SHORT_KEY = 2
SLICES = 32


def posting_keys(
    lexicon: DataFrame,
    profile: Profile,
    settings: Settings = Settings(),
    kinds: tuple[str, ...] = KINDS,
) -> DataFrame:
    """One row per (form, kind, key), not trimmed yet."""
    norm, skel = F.col("norm"), F.col("skel")
    keys = {
        SKELETON: F.array(skel),
        SKELETON_PREFIX: tx.prefixes(skel),
        FORM_PREFIX: tx.prefixes(norm, max(settings.min_input_len, 1)),
        ENDING: tx.known_endings(norm, profile),
        SKELETON_DELETE: tx.delete_variants(skel, settings.min_delete_skeleton),
    }

    def tag(kind: str) -> Column:
        return F.transform(
            keys[kind], lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
        )

    tagged = [tag(kind) for kind in kinds]
    every = F.concat(*tagged) if len(tagged) > 1 else tagged[0]
    return (
        with_keys(lexicon, profile)
        .select(*LEXICON_COLUMNS, F.explode(every).alias("k"))
        .select("k.kind", "k.key", *LEXICON_COLUMNS)
    )


def _place(*keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*by_frequency()))


def widely_shared(key: str = "key") -> Column:
    """Keys that a large share of any lexicon has: endings and very short prefixes."""
    short = F.length(key) <= SHORT_KEY
    return (F.col("kind") == ENDING) | (F.col("kind").isin(SKELETON_PREFIX, FORM_PREFIX) & short)


def shortlist(keyed: DataFrame, cap: int) -> DataFrame:
    """The rows of widely shared keys that can be among the first ``cap`` of their key.

    Each key is cut into ``SLICES`` by hash and each slice to the cap, so no task sees all
    rows of a key, and at most ``cap * SLICES`` of them are left for the ranking.
    """
    return (
        keyed.withColumn("_slice", F.pmod(F.xxhash64("form", "lemma", "form_id"), F.lit(SLICES)))
        .withColumn("_nth", _place("kind", "key", "_slice"))
        .filter(F.col("_nth") <= cap)
        .drop("_slice", "_nth")
    )


def rank_postings(keyed: DataFrame, cap: int | None) -> DataFrame:
    """Number the rows of each key, most frequent first, and keep ``cap`` (None: all).

    The cap is part of the retrieval's meaning (:func:`trimmed_keys` tells what it
    trims).  With the settings of :func:`unbrev.session.tune` each map task already cuts
    its own rows of a key to the cap; keys that much of the lexicon shares are shortened
    slice by slice before they are ranked.
    """
    if cap is None:
        return keyed.withColumn("bucket_rank", _place("kind", "key"))
    shared = widely_shared()
    few = shortlist(keyed.filter(shared), cap).unionByName(keyed.filter(~shared))
    return few.withColumn("bucket_rank", _place("kind", "key")).filter(F.col("bucket_rank") <= cap)


def trimmed_keys(keyed: DataFrame, cap: int) -> DataFrame:
    """``(kind, key, rows, trimmed)`` of the keys that have more rows than the cap."""
    sizes = keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.filter(F.col("rows") > cap).withColumn("trimmed", F.col("rows") - cap)


def build_postings(
    lexicon: DataFrame,
    profile: Profile,
    settings: Settings = Settings(),
    kinds: tuple[str, ...] = KINDS,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Trimmed postings ``(kind, key, <lexicon columns>, bucket_rank)``.

    With ``wanted`` (a table of ``kind, key``) only those keys are ranked,
    which saves most of the sort when the inputs are few.
    """
    if not settings.typo_tolerance:
        kinds = tuple(k for k in kinds if k != SKELETON_DELETE)
    keyed = posting_keys(lexicon, profile, settings, kinds)
    if wanted is not None:
        # Ranked in two parts, each of which would make all keys of the lexicon again.
        keyed = settle(keyed.join(wanted.select("kind", "key").distinct(), ["kind", "key"], "left_semi"))
    return rank_postings(keyed, settings.per_source_cap)
