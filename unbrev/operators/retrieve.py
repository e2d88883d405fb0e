"""Candidate retrieval: the capped similarity join of inputs and lexicon.

Retrieval depends on the normalised input only, so it runs once per distinct
input.  Prefix, suffix and one-edit lookups are all equi-joins on exploded
keys; there is no theta join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.functions import distance as ds
from unbrev.functions import scoring as sc
from unbrev.functions import text as tx
from unbrev.operators import postings as po
from unbrev.operators.lexicons import LEXICON_COLUMNS, by_frequency
from unbrev.operators.skew import SLICE_ROWS, sliced_join
from unbrev.profile import Profile
from unbrev.session import settle
from unbrev.settings import Settings

# Sources in the order in which the first one wins.
EXACT, PREFIX, SHORT_PREFIX, COMPLETION, SUFFIX, FUZZY = range(6)
ALL_SOURCES = (EXACT, PREFIX, SHORT_PREFIX, COMPLETION, SUFFIX, FUZZY)
# Hits for each place of a ranking that are compared before all others.
PROMISING = 4
SOURCE_NAMES = ("exact", "prefix", "short_prefix", "completion", "ending", "fuzzy1")


def retrieval_inputs(
    tokens: DataFrame, profile: Profile, settings: Settings = Settings(), column: str = "input"
) -> DataFrame:
    """Distinct ``(norm_input, input_skel)`` that may be expanded.

    Short inputs and anything that is not a plain word are left alone.
    """
    norm = tx.normalize(tx.strip(F.col(column)), profile)
    return (
        tokens.select(norm.alias("norm_input"))
        .filter(F.length("norm_input") >= settings.min_input_len)
        .filter(tx.is_plain_word(F.col("norm_input"), profile))
        .distinct()
        .withColumn("input_skel", tx.skeleton(F.col("norm_input"), profile))
    )


def _probe(source: int, kind: str, key: Column, when: Column | None = None) -> Column:
    row = F.struct(
        F.lit(source).alias("source_ord"), F.lit(kind).alias("kind"), key.alias("key")
    )
    keep = key.isNotNull() if when is None else when & key.isNotNull()
    return F.array_compact(F.array(F.when(keep, row)))


def probes(
    inputs: DataFrame,
    profile: Profile,
    settings: Settings = Settings(),
    sources: tuple[int, ...] = ALL_SOURCES,
) -> DataFrame:
    """The keys each input looks up: ``(norm_input, input_skel, source_ord,
    kind, key)``."""
    norm, skel = F.col("norm_input"), F.col("input_skel")
    n = F.length(skel)
    plans = {
        EXACT: [_probe(EXACT, po.SKELETON, skel)],
        # An empty skeleton has an exact bucket but is not a prefix.
        PREFIX: [_probe(PREFIX, po.SKELETON_PREFIX, skel, n > 0)],
        SHORT_PREFIX: [
            _probe(
                SHORT_PREFIX,
                po.SKELETON_PREFIX,
                F.substring(skel, F.lit(1), n - 1),
                n >= settings.short_prefix_min_skeleton,
            )
        ],
        COMPLETION: [_probe(COMPLETION, po.FORM_PREFIX, norm)],
        SUFFIX: [_probe(SUFFIX, po.ENDING, tx.known_ending(norm, profile))],
        FUZZY: [],
    }
    if settings.typo_tolerance:
        fuzzy = n >= settings.fuzzy_min_skeleton
        shorter = F.when(
            fuzzy, tx.delete_variants(skel, settings.min_delete_skeleton)
        ).otherwise(F.array().cast("array<string>"))

        def each(kind: str) -> Column:
            return F.transform(
                shorter,
                lambda v: F.struct(
                    F.lit(FUZZY).alias("source_ord"),
                    F.lit(kind).alias("kind"),
                    v.alias("key"),
                ),
            )

        plans[FUZZY] = [
            _probe(FUZZY, po.SKELETON_DELETE, skel, fuzzy),
            each(po.SKELETON),
            each(po.SKELETON_DELETE),
        ]
    parts = [part for s in sources for part in plans[s]]
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    return inputs.select("norm_input", "input_skel", F.explode(every).alias("p")).select(
        "norm_input", "input_skel", "p.source_ord", "p.kind", "p.key"
    )


def candidate_hits(
    probed: DataFrame,
    postings: DataFrame,
    settings: Settings = Settings(),
    slice_rows: int = SLICE_ROWS,
    settled: bool = False,
) -> DataFrame:
    """Input/form rows of all sources; a form may come from several.

    One-edit buckets are trimmed twice: each to a quarter of the cap, then their
    union per input to the most frequent forms.  Equal rows share their dense
    rank, so overlapping buckets do not use up places of other forms.  The
    window spreads rows by input, and the merging that follows needs no second
    shuffle.
    """
    fuzzy = F.col("source_ord") == FUZZY
    found = sliced_join(
        probed, postings, ["kind", "key"], ["norm_input"], slice_rows=slice_rows, left_settled=settled
    ).drop("kind", "key")
    if settings.per_source_cap is None:
        parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return found.drop("bucket_rank").repartition(parts, "norm_input")
    hits = found.filter(~fuzzy | (F.col("bucket_rank") <= settings.fuzzy_bucket_cap))
    return _first_fuzzy(hits, settings).drop("bucket_rank")


def _first_fuzzy(hits: DataFrame, settings: Settings) -> DataFrame:
    """The hits, of the one-edit ones of an input those of the most frequent forms."""
    fuzzy = F.col("source_ord") == FUZZY
    rank = F.dense_rank().over(
        Window.partitionBy("norm_input", "_fuzzy").orderBy(*by_frequency())
    )
    # A fixed number of partitions: the adaptive planner would merge these by
    # size, but the comparing that follows costs far more per byte than reading.
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        hits.withColumn("_fuzzy", fuzzy)
        .repartition(parts, "norm_input")
        .withColumn("_rank", rank)
        .filter(~F.col("_fuzzy") | (F.col("_rank") <= settings.per_source_cap))
        .drop("_rank", "_fuzzy")
    )


def candidates(
    inputs: DataFrame,
    postings: DataFrame,
    profile: Profile,
    settings: Settings = Settings(),
    sources: tuple[int, ...] = ALL_SOURCES,
    slice_rows: int = SLICE_ROWS,
    probed: DataFrame | None = None,
) -> DataFrame:
    """Distinct candidates of each input with the first source that has them.

    ``probed`` may hold the settled :func:`probes` of the inputs."""
    asked = probes(inputs, profile, settings, sources) if probed is None else probed
    hits = candidate_hits(asked, postings, settings, slice_rows, probed is not None)
    return hits.groupBy("norm_input", *LEXICON_COLUMNS).agg(
        F.min("source_ord").alias("source_ord")
    )


def scored_candidates(
    inputs: DataFrame,
    postings: DataFrame,
    profile: Profile,
    settings: Settings = Settings(),
    slice_rows: int = SLICE_ROWS,
    probed: DataFrame | None = None,
) -> DataFrame:
    """Candidates within the distance cutoff, with the signals that depend on
    the input and the form only."""
    found = candidates(inputs, postings, profile, settings, slice_rows=slice_rows, probed=probed)
    return _compared(found, profile, settings)


def _spelled(found: DataFrame, profile: Profile) -> DataFrame:
    norm = tx.normalize(F.col("form"), profile)
    return found.select(
        "*",
        tx.skeleton(F.col("norm_input"), profile).alias("input_skel"),
        norm.alias("norm"),
        tx.skeleton(norm, profile).alias("form_skel"),
    )


def _compared(found: DataFrame, profile: Profile, settings: Settings, extra: Sequence[str] = ()) -> DataFrame:
    sized = found if "form_skel" in found.columns else _spelled(found, profile)
    compare = ds.compare_udf(profile, settings)
    compared = sized.withColumn(
        "_c", compare("norm_input", "norm", "input_skel", "form_skel")
    ).filter(F.col("_c.distance") != ds.TOO_FAR)
    return with_static_signals(compared.select("*", "_c.*"), extra)


def static_score(settings: Settings) -> Column:
    """The score of a candidate by the signals that need nothing but input and form."""
    none = dict.fromkeys(("context", "user", "morph", "recency"), F.lit(0.0))
    own = {s: F.col(f"s_{s}") for s in sc.SIGNALS if s not in none}
    return sc.linear_score(settings.weights, own | none)


def highest_score(profile: Profile, settings: Settings) -> Column:
    """No less than :func:`static_score` of a pair, from the sketches of its two words."""
    first, stem, last = ds.most_shared("i_", "f_")
    share = F.when(F.col("i_cons") == 0, F.lit(1.0)).otherwise(stem / F.col("i_cons"))
    signals = {
        "skeleton": share,
        "suffix": last / 3.0,
        "prefix": first / F.col("i_size"),
        "edit": sc.edit_signal(ds.least_distance("i_", "f_", profile, settings.costs)),
        "freq": sc.log_frequency(F.col("freq")),
    }
    weights = settings.weights.as_dict()
    terms = [v * ((-1 if s == "edit" else 1) * weights[s]) for s, v in signals.items()]
    return reduce(add, terms)


def can_lead(settings: Settings) -> bool:
    """Whether :func:`leading_candidates` may be asked: only weights against which
    :func:`highest_score` is an upper bound."""
    w = settings.weights
    return min(w.skeleton, w.suffix, w.prefix, w.edit) >= 0


# Scores are rounded and summed in another order than their bounds.
_SCORE_ROOM = 1e-6


def leading_candidates(
    inputs: DataFrame,
    postings: DataFrame,
    profile: Profile,
    settings: Settings,
    name: str,
    limit: int,
    slack: float,
    slice_rows: int = SLICE_ROWS,
    probed: DataFrame | None = None,
) -> DataFrame:
    """The rows of :func:`scored_candidates` whose score is not more than ``slack`` below that
    of the ``limit``-th candidate of their input, one for each normalised ``name``, and
    perhaps some more.

    Some promising candidates of each input are compared first; their ``limit``-th score is a
    bar.  Of all other hits only those whose sketches leave a score up to the bar are shuffled
    and compared.
    """
    asked = probes(inputs, profile, settings) if probed is None else probed
    form = tx.normalize(F.col("form"), profile)
    spelled = postings.select("*", form.alias("norm"), tx.skeleton(form, profile).alias("form_skel"))
    listed = settle(spelled.select("*", *ds.sketch(F.col("norm"), F.col("form_skel"), profile, "f_")))
    fuzzy = F.col("source_ord") == FUZZY
    in_bucket = F.lit(True)
    if settings.per_source_cap is not None:
        in_bucket = F.col("bucket_rank") <= settings.fuzzy_bucket_cap
    sizes = listed.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("_all"), F.sum(in_bucket.cast("int")).alias("_near")
    )
    few = F.sum(F.when(F.col("source_ord") <= COMPLETION, F.col("_all")).otherwise(0)) < PROMISING * limit
    # Where an input has so many one-edit hits that some are left out, all are needed to
    # tell which.
    whole = F.sum(F.when(fuzzy, F.col("_near")).otherwise(0)) > (settings.per_source_cap or math.inf)
    counted = asked.join(sizes, ["kind", "key"]).groupBy("norm_input").agg(few.alias("_few"), whole.alias("_whole"))
    pair = ["norm_input", "input_skel", *LEXICON_COLUMNS, "norm", "form_skel"]
    named = inputs.select("norm_input", *ds.sketch(F.col("norm_input"), F.col("input_skel"), profile, "i_"))
    # Keys of which the lexicon has none find nothing.
    marked = settle(
        asked.join(counted, "norm_input").join(named, "norm_input").withColumn("_whole", F.col("_whole") & fuzzy)
    )
    high = highest_score(profile, settings)
    parts = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    tried = F.col("_few") & ~F.col("_whole") | (F.col("source_ord") <= COMPLETION)
    promising = (
        sliced_join(
            marked.filter(tried), listed, ["kind", "key"], ["norm_input"],
            slice_rows=slice_rows, left_settled=True, right_settled=True,
        )
        .filter(~fuzzy | in_bucket)
        .select(*pair, "source_ord", high.alias("_high"))
        .withColumn("_nth", F.row_number().over(Window.partitionBy("norm_input").orderBy(F.desc("_high"), "form")))
        .filter(F.col("_nth") <= PROMISING * limit)
        .repartition(parts, "norm_input")
        .groupBy(*pair)
        .agg(F.min("source_ord").alias("source_ord"))
    )
    best = (
        _compared(promising, profile, settings)
        .groupBy("norm_input", tx.normalize(F.col(name), profile).alias("_name"))
        .agg(F.max(static_score(settings)).alias("_score"))
        .groupBy("norm_input")
        .agg(F.get(F.sort_array(F.collect_list("_score"), asc=False), F.lit(limit - 1)).alias("_bar"))
    )

    # A hit that cannot reach the bar goes no further than this join.
    found = sliced_join(
        settle(marked.join(best, "norm_input", "left")), listed, ["kind", "key"], ["norm_input"],
        slice_rows=slice_rows, left_settled=True, right_settled=True,
    ).filter(~fuzzy | in_bucket)
    bar = F.coalesce(F.col("_bar") - (slack + _SCORE_ROOM), F.lit(-math.inf))
    kept = [*pair, "source_ord", "_bar"]
    hits = found.filter(~F.col("_whole")).filter(high >= bar).select(*kept)
    if settings.per_source_cap is not None:
        first = _first_fuzzy(found.filter("_whole").drop("kind", "key"), settings)
        hits = hits.unionByName(first.filter(high >= bar).select(*kept))
    each = (
        hits.repartition(parts, "norm_input")
        .groupBy(*pair)
        .agg(F.min("source_ord").alias("source_ord"), F.first("_bar").alias("_bar"))
    )
    return _compared(each, profile, settings, ["_bar"]).filter(static_score(settings) >= bar).drop("_bar")


def with_static_signals(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Add the signals ``s_skeleton, s_suffix, s_prefix, s_edit, s_freq``."""
    typed, size = F.col("norm_input"), F.length("input_skel")
    stem = (
        F.when(F.col("input_skel") == F.col("form_skel"), F.lit(1.0))
        .when(size == 0, F.lit(0.0))
        .otherwise(F.col("skel_prefix") / size)
    )
    return rows.select(
        "norm_input",
        "input_skel",
        "norm",
        *LEXICON_COLUMNS,
        "source_ord",
        "distance",
        *extra,
        stem.alias("s_skeleton"),
        (tx.common_ending_len(typed, F.col("norm")) / 3.0).alias("s_suffix"),
        (F.col("prefix") / F.length(typed)).alias("s_prefix"),
        sc.edit_signal(F.col("distance")).alias("s_edit"),
        sc.log_frequency(F.col("freq")).alias("s_freq"),
    )
