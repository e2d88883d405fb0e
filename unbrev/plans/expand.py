"""Ranked expansion of a table of tokens: flat, grouped by lemma, masked.

``queries`` has ``query_id, input`` and, as far as the used signals need them,
``context`` (array of the words before, most recent last), ``user_id``,
``session_id`` and ``tick`` (plain words the session had seen by then).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.functions import distance as ds
from unbrev.functions import scoring as sc
from unbrev.functions import text as tx
from unbrev.operators import retrieve as rt
from unbrev.operators.blocked import row_numbers
from unbrev.operators.postings import build_postings
from unbrev.operators.skew import SLICE_ROWS, sliced_join
from unbrev.plans.history import form_popularity
from unbrev.plans.lexicon import paradigm_forms
from unbrev.plans.sessions import last_seen_as_of
from unbrev.plans.signals import with_government
from unbrev.profile import Profile
from unbrev.session import settle
from unbrev.settings import RECENCY_HALF_LIFE, SESSION_MEMORY, SHORTCUT_SCORE, Settings

OOV_SOURCE, SHORTCUT_SOURCE = "session", "shortcut"


@dataclass(frozen=True)
class Knowledge:
    """The tables that expansion draws on; only the lexicon is required.

    ``postings`` may hold prebuilt postings; ``pmi`` is a
    :func:`unbrev.plans.corpus.pmi_table`; ``session_words`` a
    :func:`unbrev.plans.sessions.session_ticks` table.
    ``static`` may hold the :func:`static_candidates` of the same queries, if
    several rankings share them.  ``context_scorer`` replaces the pair statistics: it receives the candidate
    rows and returns them with a column ``s_context`` (0 is neutral); see
    :func:`unbrev.plans.signals.batch_scorer`.  ``government (prep, case)`` replaces the
    profile's rules.
    """

    lexicon: DataFrame
    postings: DataFrame | None = None
    pmi: DataFrame | None = None
    history: DataFrame | None = None
    session_words: DataFrame | None = None
    shortcuts: DataFrame | None = None
    paradigms: DataFrame | None = None
    static: DataFrame | None = None
    context_scorer: Callable[[DataFrame], DataFrame] | None = None
    government: DataFrame | None = None


def prepare_queries(queries: DataFrame, profile: Profile) -> DataFrame:
    """Add ``norm_input, input_skel, prev_key, prev_word``."""
    out = queries.withColumn(
        "norm_input", tx.normalize(tx.strip(F.col("input")), profile)
    ).withColumn("input_skel", tx.skeleton(F.col("norm_input"), profile))
    if "context" in queries.columns:
        return out.withColumns(
            {
                "prev_key": tx.last_context_key(F.col("context"), profile),
                "prev_word": tx.last_context_word(F.col("context"), profile),
            }
        )
    return out.withColumns({"prev_key": F.lit(""), "prev_word": F.lit("")})


def static_candidates(
    prepared: DataFrame,
    known: Knowledge,
    profile: Profile,
    settings: Settings = Settings(),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Scored candidates of each distinct input (context plays no part)."""
    if known.static is not None:
        return known.static
    inputs, postings, probed = _lookup(prepared, known, profile, settings)
    return rt.scored_candidates(inputs, postings, profile, settings, slice_rows, probed)


def _lookup(
    prepared: DataFrame, known: Knowledge, profile: Profile, settings: Settings
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct inputs, the postings they are looked up in and their settled probes."""
    inputs = settle(rt.retrieval_inputs(prepared, profile, settings, "norm_input"))
    # Looked up by the postings and by the join.
    probed = settle(rt.probes(inputs, profile, settings))
    postings = known.postings
    if postings is None:
        postings = build_postings(known.lexicon, profile, settings, wanted=probed)
    return inputs, postings, probed


def candidate_signals(
    prepared: DataFrame,
    known: Knowledge,
    profile: Profile,
    settings: Settings = Settings(),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per query and candidate with all nine signals (not weighted)."""
    static = static_candidates(prepared, known, profile, settings, slice_rows)
    rows = sliced_join(
        prepared.drop("input_skel"), static, ["norm_input"], ["query_id"], slice_rows=slice_rows
    )
    if known.government is not None:
        rows = with_government(rows, known.government)
    else:
        rows = rows.withColumn(
            "s_morph", tx.case_agreement(F.col("prev_word"), F.col("tags"), profile)
        )
    rows = _context_signal(rows, known, profile)
    rows = _user_signal(rows, known, prepared)
    return _recency_signal(rows, known, prepared)


def used_candidates(asks: DataFrame, static: DataFrame, known: Knowledge) -> DataFrame:
    """``(session_id, tick, norm_input, norm, recency)``: the candidates of each ask that its
    session had used by then.

    ``static`` has few candidates for each input, so each input of a session is joined with
    all of them.
    """
    spoken = known.session_words.filter("is_plain").select("session_id", "norm").distinct()
    times = asks.select("session_id", "tick", "norm_input").distinct()
    sessions = times.select("session_id", "norm_input").distinct()
    pairs = sessions.join(static.select("norm_input", "norm").distinct(), "norm_input")
    # A sort would order every pair; the words of the sessions are far fewer.
    near = pairs.join(spoken.hint("shuffle_hash"), ["session_id", "norm"], "left_semi")
    near = settle(near.join(times, ["session_id", "norm_input"]))
    seen = last_seen_as_of(known.session_words, near).select("session_id", "norm", "tick", "recency")
    return near.join(seen, ["session_id", "norm", "tick"])


def session_signals(
    prepared: DataFrame,
    known: Knowledge,
    profile: Profile,
    settings: Settings,
    name: str,
    limit: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The rows of :func:`candidate_signals` that can be among the first ``limit`` of a query,
    one for each normalised ``name`` (form or lemma).

    For rankings in which only the recency tells queries of one input and previous word
    apart.  Recency never lowers a score, so a candidate that the session has not used is
    among the first of a query only if it is so without any recency.  Those are ranked once
    for each input and previous word, and beside them stand the candidates that the
    session has used.  A used one may also be there without its recency, where it
    ranks no better than with it.  Recency adds its weight at most, so what is further than
    that below the last place is among the first of no query and is not even compared.
    """
    slack = settings.weights.recency
    if "context" in prepared.columns:
        slack += abs(settings.weights.morph)
    inputs, postings, probed = _lookup(prepared, known, profile, settings)
    # Ranked, and looked up twice for recent words.
    static = settle(
        rt.leading_candidates(inputs, postings, profile, settings, name, limit, slack, slice_rows, probed)
    )
    frames = prepared.select("norm_input", "prev_word").distinct()
    morph = tx.case_agreement(F.col("prev_word"), F.col("tags"), profile)
    rows = sliced_join(
        frames, static, ["norm_input"], ["prev_word"], slice_rows=slice_rows, right_settled=True
    ).withColumns(
        {"s_context": F.lit(0.0), "s_user": F.lit(0.0), "s_morph": morph, "s_recency": F.lit(0.0)}
    )
    order = [
        sc.linear_score(settings.weights).desc(), F.col("source_ord"), F.desc("freq"),
        F.col("form_id"), F.col("form"), F.col("lemma"),
    ]
    frame = ["norm_input", "prev_word"]
    best = F.row_number().over(Window.partitionBy(*frame, "_key").orderBy(*order))
    place = F.row_number().over(Window.partitionBy(*frame).orderBy(*order))
    first = (
        rows.withColumn("_key", tx.normalize(F.col(name), profile))
        .repartition(*frame)
        .withColumn("_best", best)
        .filter(F.col("_best") == 1)
        .withColumn("_place", place)
        .filter(F.col("_place") <= limit)
        .drop("_key", "_best", "_place")
    )
    queries = prepared.select("query_id", "session_id", "tick", *frame)
    plain = queries.join(first, frame)
    used = used_candidates(queries, static, known)
    recent = (
        used.join(static, ["norm_input", "norm"])
        .join(queries, ["session_id", "tick", "norm_input"])
        .withColumns({"s_context": F.lit(0.0), "s_user": F.lit(0.0), "s_morph": morph})
        .withColumnRenamed("recency", "s_recency")
    )
    return plain.unionByName(recent.select(*plain.columns))


def _context_signal(rows: DataFrame, known: Knowledge, profile: Profile) -> DataFrame:
    if known.context_scorer is not None:
        return known.context_scorer(rows)
    if known.pmi is None:
        return rows.withColumn("s_context", F.lit(0.0))
    pmi = known.pmi.select(
        F.col("prev").alias("prev_key"), F.col("word").alias("norm"), "pmi"
    )
    return rows.join(pmi, ["prev_key", "norm"], "left").withColumn(
        "s_context", F.coalesce("pmi", F.lit(0.0))
    )


def _user_signal(rows: DataFrame, known: Knowledge, prepared: DataFrame) -> DataFrame:
    if known.history is None or "user_id" not in prepared.columns:
        return rows.withColumn("s_user", F.lit(0.0))
    pairs = known.history.select(
        "user_id",
        F.col("skeleton").alias("input_skel"),
        F.col("form").alias("norm"),
        "confirmed",
        "reverted",
    )
    forms = form_popularity(known.history).withColumnRenamed("form", "norm")
    return (
        rows.join(pairs, ["user_id", "input_skel", "norm"], "left")
        .join(forms, ["user_id", "norm"], "left")
        .withColumn(
            "s_user",
            sc.history_prior(F.col("confirmed"), F.col("reverted"), F.col("form_count")),
        )
        .drop("confirmed", "reverted", "form_count")
    )


def _recency_signal(rows: DataFrame, known: Knowledge, prepared: DataFrame) -> DataFrame:
    if known.session_words is None or "session_id" not in prepared.columns:
        return rows.withColumn("s_recency", F.lit(0.0))
    seen = last_seen_as_of(known.session_words, rows).select(
        "session_id", "norm", "tick", "recency"
    )
    return (
        rows.join(seen, ["session_id", "norm", "tick"], "left")
        .withColumn("s_recency", F.coalesce("recency", F.lit(0.0)))
        .drop("recency")
    )


def _shortcut_rows(
    prepared: DataFrame, known: Knowledge, profile: Profile
) -> DataFrame | None:
    """Exact shorthand expansions of the queries; no length or letter gate."""
    if known.shortcuts is None:
        return None
    table = known.shortcuts.select(
        F.col("key").alias("norm_input"), "ord", "form", "lemma"
    )
    return prepared.join(table, "norm_input").select(
        "query_id",
        F.lit(1).alias("is_shortcut"),
        F.col("ord").cast("int").alias("ord"),
        F.lit(SHORTCUT_SCORE).alias("score"),
        F.lit(0).alias("is_oov"),
        F.lit(0).alias("source_ord"),
        F.lit(0.0).alias("freq"),
        F.lit(0).cast("bigint").alias("form_id"),
        "form",
        "lemma",
    )


MEMORY_TICKS = math.ceil(SESSION_MEMORY * RECENCY_HALF_LIFE)


def words_in_memory(
    asks: DataFrame,
    uses: DataFrame,
    on: Sequence[str],
    memory: int = MEMORY_TICKS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each ask with the words that its session used in the last ``memory`` ticks.

    ``asks`` has ``session_id, tick`` and ``uses`` has ``session_id, norm, tick``, both
    with the columns ``on`` that must agree.  An interval join in bins of ``memory``
    ticks: a word is paired with later asks of its own bin and of the next one only, once
    each, so pairs grow with the length of a session and not with its square.
    """
    bin_of = F.floor(F.col("tick") / memory)
    again = Window.partitionBy("session_id", "norm").orderBy("_bin")
    used = (
        uses.groupBy("session_id", "norm", *[c for c in on if c != "session_id"], bin_of.alias("_bin"))
        .agg(F.min("tick").alias("_from"), F.max("tick").alias("_to"))
        .withColumn("_later", F.struct(F.lead("_bin").over(again).alias("bin"), F.lead("_from").over(again).alias("at")))
        .withColumn("_own", F.col("_bin"))
        .withColumn("_bin", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    )
    here = (F.col("_own") == F.col("_bin")) & (F.col("_from") <= F.col("tick"))
    newer = (F.col("_later.bin") == F.col("_bin")) & (F.col("_later.at") <= F.col("tick"))
    before = (F.col("_own") < F.col("_bin")) & (F.col("_to") > F.col("tick") - memory)
    return (
        sliced_join(
            asks.withColumn("_bin", bin_of), used, [*on, "_bin"], ["norm_input", "tick"], slice_rows=slice_rows
        )
        .filter(here | (before & ~F.coalesce(newer, F.lit(False))))
        .drop("_bin", "_own", "_from", "_to", "_later")
    )


def session_candidates(
    prepared: DataFrame,
    known: Knowledge,
    profile: Profile,
    settings: Settings = Settings(),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Candidates from words of the session that the lexicon does not have.

    A word is tried when its skeleton shares the first letter with the input's,
    the skeleton lengths can be within the cutoff, and its last use is not longer ago
    than ``MEMORY_TICKS``.  Each (session, input, tick) is tried once, against each word
    once.
    """
    keys = ["session_id", "norm"]
    in_lexicon = known.lexicon.select(
        tx.normalize(F.col("form"), profile).alias("norm")
    ).distinct()
    skel = tx.skeleton(F.col("norm"), profile)
    oov = (
        known.session_words.filter("is_plain")
        .join(in_lexicon, "norm", "left_anti")
        .withColumn("form_skel", skel)
        .filter(F.col("form_skel") != "")
    )
    words = oov.select(
        *keys,
        "tick",
        "form_skel",
        F.left("form_skel", F.lit(1)).alias("_head"),
        F.length("form_skel").alias("_cons"),
    )
    swap = min(
        settings.costs.substitute_neighbour,
        settings.costs.substitute_vowel,
        settings.costs.substitute,
    )
    asked = (
        prepared.filter(F.length("norm_input") >= settings.min_input_len)
        .filter(tx.is_plain_word(F.col("norm_input"), profile))
        .filter(F.col("input_skel") != "")
        .select("session_id", "tick", "norm_input", "input_skel")
        .distinct()
    )
    # Each consonant one side has more than the other costs at least the
    # cheapest substitution, so only these skeleton lengths can be near.
    cheapest = min(swap, settings.costs.delete, settings.costs.insert_consonant)
    reach = F.floor(ds.cutoff(F.col("norm_input"), settings) / cheapest).cast("int")
    size = F.length("input_skel")
    probes = asked.select(
        "*",
        F.left("input_skel", F.lit(1)).alias("_head"),
        F.explode(F.sequence(F.greatest(size - reach, F.lit(1)), size + reach)).alias("_cons"),
    )
    compare = ds.compare_udf(profile, settings)
    paired = words_in_memory(
        probes, words, ["session_id", "_head", "_cons"], slice_rows=slice_rows
    )
    near = (
        paired.withColumn("form_skel", skel)
        .withColumn("_c", compare("norm_input", "norm", "input_skel", "form_skel"))
        .filter(F.col("_c.distance") != ds.TOO_FAR)
        .select("*", "_c.*")
    )
    near = settle(near)
    seen = last_seen_as_of(known.session_words, near).select(*keys, "tick", "last_tick", "recency")
    spelled = known.session_words.filter("is_plain").select(
        *keys, F.col("tick").alias("last_tick"), "display"
    )
    # The spelling shown is that of the last use.
    placed = near.join(seen, [*keys, "tick"]).join(spelled, [*keys, "last_tick"])
    ready = rt.with_static_signals(
        placed.select(
            "session_id", "tick", "norm_input", "input_skel", "norm", "form_skel",
            F.lit(0).cast("bigint").alias("form_id"),
            F.col("display").alias("form"),
            F.col("display").alias("lemma"),
            F.lit(0.0).alias("freq"),
            F.lit("").alias("tags"),
            F.lit(0).alias("source_ord"),
            "distance", "prefix", "skel_prefix", "recency",
        ),
        extra=["session_id", "tick", "recency"],
    )
    rows = prepared.drop("input_skel").join(ready, ["session_id", "tick", "norm_input"])
    rows = rows.withColumns(
        {"s_morph": F.lit(0.0), "s_recency": F.col("recency")}
    ).drop("recency")
    return _user_signal(_context_signal(rows, known, profile), known, prepared)


def _as_ranked(rows: DataFrame, settings: Settings, is_oov: int) -> DataFrame:
    return rows.select(
        "query_id",
        F.lit(0).alias("is_shortcut"),
        F.lit(0).alias("ord"),
        sc.linear_score(settings.weights).alias("score"),
        F.lit(is_oov).alias("is_oov"),
        "source_ord",
        F.col("freq").cast("double").alias("freq"),
        "form_id",
        "form",
        "lemma",
    )


def ranking_order() -> list[Column]:
    """Best first: shorthands, then score; ties go to the lexicon, the earlier
    source, the more frequent and the earlier form."""
    return [
        F.desc("is_shortcut"), F.col("ord"), F.desc("score"), F.col("is_oov"),
        F.col("source_ord"), F.desc("freq"), F.col("form_id"), F.col("form"), F.col("lemma"),
    ]


def complete_ranking(
    queries: DataFrame,
    known: Knowledge,
    profile: Profile,
    settings: Settings = Settings(),
    enough: int | None = None,
    slice_rows: int = SLICE_ROWS,
    first: tuple[str, int] | None = None,
) -> DataFrame:
    """Scored rows of every candidate of every query, not limited.

    With ``enough``, queries whose shorthands already fill that many places are
    not looked up in the lexicon.  With ``first``, a column and a number, rows may be left
    out that cannot be among the first so many with different values of the column.
    """
    prepared = prepare_queries(queries, profile)
    quick = _shortcut_rows(prepared, known, profile)
    open_queries = prepared
    if quick is not None:
        # Asked for the queries that are filled, wherever open ones are read, and for the result.
        quick = settle(quick)
    if quick is not None and enough is not None:
        filled = (
            quick.groupBy("query_id")
            .agg(F.count_distinct(tx.normalize(F.col("form"), profile)).alias("n"))
            .filter(F.col("n") >= enough)
        )
        open_queries = prepared.join(filled, "query_id", "left_anti")
    in_session = known.session_words is not None and "session_id" in queries.columns
    if in_session:
        # Read for their inputs, the words used and the words unknown.
        open_queries = settle(open_queries)
    # Prebuilt postings or candidates may rest on other keys than the session's words get.
    apart = known.static is not None or known.postings is not None or known.government is not None
    by_recency = in_session and not apart and known.pmi is None and known.context_scorer is None
    by_recency &= (known.history is None or "user_id" not in queries.columns) and settings.weights.recency >= 0
    if by_recency and first is not None and rt.can_lead(settings):
        signals = session_signals(open_queries, known, profile, settings, *first, slice_rows)
    else:
        if in_session and known.static is None:
            known = replace(known, static=settle(static_candidates(open_queries, known, profile, settings, slice_rows)))
        signals = candidate_signals(open_queries, known, profile, settings, slice_rows)
    ranked = _as_ranked(signals, settings, 0)
    if in_session:
        oov = session_candidates(open_queries, known, profile, settings, slice_rows)
        ranked = ranked.unionByName(_as_ranked(oov, settings, 1))
    return ranked if quick is None else ranked.unionByName(quick)


def _first_of(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """Best row of each (query, key), then the first ``limit`` per query.

    Both windows work on rows of one query, which the caps on retrieval bound,
    and share one shuffle.
    """
    best = F.row_number().over(
        Window.partitionBy("query_id", "_key").orderBy(*ranking_order())
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking_order()))
    return (
        rows.withColumn("_key", key)
        .repartition("query_id")
        .withColumn("_best", best)
        .filter(F.col("_best") == 1)
        .withColumn("rank", place)
        .filter(F.col("rank") <= limit)
        .drop("_key", "_best")
    )


def _source_name() -> Column:
    names = F.array(*[F.lit(n) for n in rt.SOURCE_NAMES])
    return (
        F.when(F.col("is_shortcut") == 1, SHORTCUT_SOURCE)
        .when(F.col("is_oov") == 1, OOV_SOURCE)
        .otherwise(F.get(names, F.col("source_ord")))
    )


def expand_tokens(
    queries: DataFrame,
    known: Knowledge,
    profile: Profile,
    settings: Settings = Settings(),
    limit: int = 5,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(query_id, rank, form, lemma, score, source)``: the best forms of each
    query, one row per normalised form."""
    ranked = complete_ranking(queries, known, profile, settings, limit, slice_rows, ("form", limit))
    return _first_of(ranked, tx.normalize(F.col("form"), profile), limit).select(
        "query_id", "rank", "form", "lemma", "score", _source_name().alias("source")
    )


def expand_tokens_grouped(
    queries: DataFrame,
    known: Knowledge,
    profile: Profile,
    settings: Settings = Settings(),
    limit: int = 3,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(query_id, rank, lemma, form, score, source)``: the best form of each
    lemma, ranked over the complete list so that no lemma crowds out others."""
    ranked = complete_ranking(queries, known, profile, settings, None, slice_rows, ("lemma", limit))
    return _first_of(ranked, tx.normalize(F.col("lemma"), profile), limit).select(
        "query_id", "rank", "lemma", "form", "score", _source_name().alias("source")
    )


def forms_of_lemma(
    lexicon: DataFrame, profile: Profile, paradigms: DataFrame | None = None
) -> DataFrame:
    """``(lemma, ord, form)``: the paradigm's order where there is one, else the
    lexicon's forms, most frequent first."""
    keyed = lexicon.withColumn("_lemma", tx.normalize(F.col("lemma"), profile))
    fall = -F.col("freq")
    listed = row_numbers(
        keyed,
        ["_lemma"],
        [fall, F.floor(F.col("form_id") / 4096), F.left("form", F.lit(2))],
        [fall, F.col("form_id"), F.col("form")],
        "ord",
    ).select(F.col("_lemma").alias("lemma"), F.col("ord").cast("int").alias("ord"), "form")
    if paradigms is None:
        return listed
    declined = paradigm_forms(paradigms)
    rest = listed.join(declined.select("lemma").distinct(), "lemma", "left_anti")
    return rest.unionByName(declined)


def group_variants(
    groups: DataFrame, forms: DataFrame, profile: Profile
) -> DataFrame:
    """``(query_id, rank, ord, variant)``: the other forms of each group's lemma.

    Kept as rows, because nothing bounds the number of forms of a lemma; see
    :func:`nest_variants` for the array view.
    """
    lookup = forms.select(F.col("lemma").alias("_lemma"), "ord", F.col("form").alias("variant"))
    return (
        groups.filter(F.col("source") != OOV_SOURCE)
        .withColumn("_lemma", tx.normalize(F.col("lemma"), profile))
        .join(lookup, "_lemma")
        .filter(F.col("variant") != F.col("form"))
        .select("query_id", "rank", "ord", "variant")
    )


def nest_variants(
    groups: DataFrame, variants: DataFrame
) -> DataFrame:
    """Groups with a ``variants`` array, for showing.

    An array must fit into one task; the rows of :func:`group_variants` are the form
    for any number of forms.
    """
    keys = ["query_id", "rank"]
    arrays = variants.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ord", "variant"))),
            lambda v: v["variant"],
        ).alias("variants")
    )
    none = F.array().cast("array<string>")
    return groups.join(arrays, keys, "left").withColumn(
        "variants", F.coalesce("variants", none)
    )


def mask_active(
    mask: Column, when_polite: Column | bool, register: Column | None
) -> Column:
    """Whether twins are offered: masking on and, if tied to tone, a polite
    window; without any tone to read the tie has no effect."""
    if register is None:
        return mask
    tied = F.lit(when_polite) if isinstance(when_polite, bool) else when_polite
    return mask & (~tied | register.isNull() | (register == "polite"))


def with_masked_twins(
    rows: DataFrame,
    mask_lemmas: DataFrame,
    profile: Profile,
    limit: int,
    active: Column | None = None,
    grouped: bool = False,
) -> DataFrame:
    """Offer a masked twin right after each form whose lemma is on the list.

    Flat twins give way to anything shown before them, group twins to earlier
    twins only.  The limit is applied afterwards, so a twin can push out a
    later row.
    """
    listed = mask_lemmas.select(
        tx.normalize(F.col("lemma"), profile).alias("_lemma"), F.lit(True).alias("_listed")
    ).distinct()
    on = F.lit(True) if active is None else active
    marked = rows.withColumn("_lemma", tx.normalize(F.col("lemma"), profile)).join(
        listed, "_lemma", "left"
    )
    twin = F.when(on & F.coalesce("_listed", F.lit(False)), tx.mask_form(F.col("form")))
    shown = F.array(
        F.struct(
            F.lit(0).alias("is_twin"), F.col("form").alias("form"), F.col("lemma").alias("lemma")
        ),
        F.when(
            twin.isNotNull(),
            F.struct(F.lit(1).alias("is_twin"), twin.alias("form"), twin.alias("lemma")),
        ),
    )
    exploded = marked.select(
        "query_id", "rank", "score", F.explode(F.array_compact(shown)).alias("s")
    ).select("query_id", "rank", "score", "s.*")
    seen = ["query_id", "_key", "is_twin"] if grouped else ["query_id", "_key"]
    repeat = F.row_number().over(
        Window.partitionBy(*seen).orderBy("rank", "is_twin")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_rank", "is_twin"))
    return (
        exploded.withColumn("_key", tx.normalize(F.col("form"), profile))
        .withColumn("_nth", repeat)
        .filter((F.col("is_twin") == 0) | (F.col("_nth") == 1))
        .withColumnRenamed("rank", "_rank")
        .withColumn("rank", place)
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "form", "lemma", "score", F.col("is_twin"))
    )
