"""Evaluation, weight sweeps and snapshots over labelled cases.

``cases`` has ``case_id, input, expected, tag, context``.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unbrev.functions import distance as ds
from unbrev.functions import scoring as sc
from unbrev.functions import text as tx
from unbrev.operators.blocked import row_numbers
from unbrev.operators import retrieve as rt
from unbrev.operators.lexicons import lexicon_block, lexicon_order, with_keys
from unbrev.plans import expand as ex
from unbrev.profile import Profile
from unbrev.session import settle
from unbrev.settings import (
    ADOPT_MARGIN,
    RECENCY_HALF_LIFE,
    TAG_TOLERANCE,
    Settings,
    Weights,
)

FLAT_K = 10
GROUPS = 3
# Weights tried by the recency sweep, and the share of reuse.
RECENCY_GRID = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
REUSE_SHARE = 0.8


def as_queries(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("case_id").alias("query_id"), "input", "context")


def case_outcomes(
    cases: DataFrame, flat: DataFrame, groups: DataFrame, forms: DataFrame, profile: Profile
) -> DataFrame:
    """One row per case: where the expected form came out, and what it saves."""
    wanted = cases.select(F.col("case_id").alias("query_id"), "expected")
    first_hit = F.min(F.when(F.col("form") == F.col("expected"), F.col("rank")))
    listed = (
        flat.join(wanted, "query_id")
        .groupBy("query_id")
        .agg(
            first_hit.alias("hit_rank"),
            F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
            F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        )
    )
    best = (
        groups.join(wanted, "query_id")
        .groupBy("query_id")
        .agg(F.max(F.col("form") == F.col("expected")).alias("best_hit"))
    )
    # Only the variant that is expected is looked up, not all of them.
    held = (
        groups.filter(F.col("source") != ex.OOV_SOURCE)
        .select("query_id", tx.normalize(F.col("lemma"), profile).alias("lemma"))
        .join(wanted, "query_id")
        .join(
            forms.select("lemma", F.col("form").alias("expected")).distinct(),
            ["lemma", "expected"],
            "left_semi",
        )
        .select("query_id", F.lit(True).alias("held"))
        .distinct()
    )
    rank = F.col("hit_rank")
    best_hit = F.coalesce("best_hit", F.lit(False))
    lemma_hit = best_hit | F.coalesce("held", F.lit(False))
    return (
        cases.join(listed.withColumnRenamed("query_id", "case_id"), "case_id", "left")
        .join(best.withColumnRenamed("query_id", "case_id"), "case_id", "left")
        .join(held.withColumnRenamed("query_id", "case_id"), "case_id", "left")
        .select(
            "case_id",
            "input",
            "expected",
            "tag",
            F.coalesce(rank == 1, F.lit(False)).alias("top1"),
            F.coalesce(rank <= GROUPS, F.lit(False)).alias("top3"),
            F.coalesce(1.0 / rank, F.lit(0.0)).alias("rr"),
            sc.keystroke_savings(F.col("input"), F.col("expected")).alias("savings"),
            F.when(F.col("s2").isNotNull(), F.col("s1") - F.col("s2")).alias("margin"),
            best_hit.alias("best_form_hit"),
            lemma_hit.alias("lemma_hit"),
        )
    )


def metrics(outcomes: DataFrame) -> DataFrame:
    """The dashboard: one row overall (``tag`` null) and one per tag."""

    def share(flag: str) -> Column:
        return F.avg(F.col(flag).cast("double"))

    def saved(flag: str) -> Column:
        return F.avg(F.when(F.col(flag), F.col("savings")).otherwise(0.0))

    hold = F.col("lemma_hit") & ~F.col("best_form_hit")
    return outcomes.rollup("tag").agg(
        F.grouping("tag").cast("int").alias("overall"),
        F.count(F.lit(1)).alias("cases"),
        share("top1").alias("top1"),
        share("top3").alias("top3"),
        F.avg("rr").alias("mrr"),
        saved("top1").alias("ks_realized"),
        saved("top3").alias("ks_oracle"),
        F.avg("margin").alias("margin"),
        share("lemma_hit").alias("lemma_hit"),
        share("best_form_hit").alias("best_form_hit"),
        F.avg(hold.cast("double")).alias("hold_success"),
    )


def with_static(
    queries: DataFrame, known: ex.Knowledge, profile: Profile, settings: Settings
) -> ex.Knowledge:
    """Work the candidates out once, for jobs that rank them several times."""
    prepared = ex.prepare_queries(queries, profile)
    found = ex.static_candidates(prepared, known, profile, settings)
    return replace(known, static=settle(found))


def evaluate(
    cases: DataFrame, known: ex.Knowledge, profile: Profile, settings: Settings = Settings()
) -> DataFrame:
    """Outcome row per case; feed it to :func:`metrics`."""
    queries = as_queries(cases)
    known = with_static(queries, known, profile, settings)
    flat = ex.expand_tokens(queries, known, profile, settings, FLAT_K)
    groups = ex.expand_tokens_grouped(queries, known, profile, settings, GROUPS)
    forms = ex.forms_of_lemma(known.lexicon, profile, known.paradigms)
    return case_outcomes(cases, flat, groups, forms, profile)


def misses(outcomes: DataFrame, flat: DataFrame) -> DataFrame:
    """``(input, expected, tag, got)`` of cases outside the top three."""
    got = (
        flat.filter(F.col("rank") <= GROUPS)
        .groupBy(F.col("query_id").alias("case_id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "form"))).alias("f"))
        .select("case_id", F.array_join(F.transform("f", lambda x: x["form"]), "|").alias("got"))
    )
    return (
        outcomes.filter(~F.col("top3"))
        .join(got, "case_id", "left")
        .select("input", "expected", "tag", F.coalesce("got", F.lit("")).alias("got"))
    )


def snapshot(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """``(input, context, ranked)``: the strip of each case as one comparable
    line, repeated cases once."""
    line = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "form", "score"))),
            lambda g: F.concat(g["form"], F.lit(":"), F.format_string("%.2f", g["score"])),
        ),
        "|",
    )
    shown = groups.groupBy(F.col("query_id").alias("case_id")).agg(line.alias("ranked"))
    return (
        cases.join(shown, "case_id", "left")
        .select(
            "input",
            F.array_join("context", " ").alias("context"),
            F.coalesce("ranked", F.lit("")).alias("ranked"),
        )
        .distinct()
    )


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines that differ: ``(input, context, before, after)``."""
    keys = ["input", "context"]
    return (
        before.withColumnRenamed("ranked", "before")
        .join(after.withColumnRenamed("ranked", "after"), keys, "full_outer")
        .filter(~F.col("before").eqNullSafe(F.col("after")))
    )


def _rank_with_weights(
    signals: DataFrame, vectors: Mapping[str, Weights], profile: Profile, limit: int
) -> DataFrame:
    """Rank every case's candidates under each weight vector.

    Rows are spread by case before they are repeated per vector, so they cross
    the network once however many vectors there are.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("vector"),
                *[F.lit(v).alias(f"w_{k}") for k, v in w.as_dict().items()],
            )
            for name, w in vectors.items()
        ]
    )
    weights = {k: F.col(f"w_{k}") for k in Weights().as_dict()}
    order = [
        F.desc("score"), "source_ord", F.desc("freq"), "form_id", "form", "lemma",
    ]
    best = F.row_number().over(
        Window.partitionBy("query_id", "vector", "norm").orderBy(*order)
    )
    place = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(*order))
    return (
        signals.repartition("query_id")
        .withColumn("_w", F.explode(table))
        .select("*", "_w.*")
        .withColumn("score", sc.linear_score(weights))
        .withColumn("_best", best)
        .filter(F.col("_best") == 1)
        .withColumn("rank", place)
        .filter(F.col("rank") <= limit)
        .select("query_id", "vector", "rank", "form")
    )


def vector_outcomes(
    cases: DataFrame, signals: DataFrame, vectors: Mapping[str, Weights], profile: Profile
) -> DataFrame:
    """``(vector, case_id, tag, hit_rank)`` for every vector and case."""
    ranked = _rank_with_weights(signals, vectors, profile, FLAT_K)
    wanted = cases.select(F.col("case_id").alias("query_id"), F.col("expected").alias("form"))
    hits = (
        ranked.join(wanted, ["query_id", "form"])
        .groupBy(F.col("query_id").alias("case_id"), "vector")
        .agg(F.min("rank").alias("hit_rank"))
    )
    every = cases.select(
        "case_id", "tag", F.explode(F.array(*[F.lit(v) for v in vectors])).alias("vector")
    )
    return every.join(hits, ["case_id", "vector"], "left")


def sweep_weights(
    cases: DataFrame,
    signals: DataFrame,
    vectors: Mapping[str, Weights],
    profile: Profile,
    baseline: str = "baseline",
) -> DataFrame:
    """Objective of every weight vector and whether to adopt it.

    ``signals`` comes from :func:`unbrev.plans.expand.candidate_signals` and
    does not depend on weights, so one pass serves all vectors.  A vector must
    gain more than the margin and lose no more than the tolerance on any tag.
    """
    rank = F.col("hit_rank")
    top1 = F.coalesce(rank == 1, F.lit(False)).cast("double")
    top3 = F.coalesce(rank <= GROUPS, F.lit(False)).cast("double")
    rr = F.coalesce(1.0 / rank, F.lit(0.0))
    by_tag = (
        vector_outcomes(cases, signals, vectors, profile)
        .groupBy("vector", "tag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(top1).alias("top1"),
            F.sum(top3).alias("top3"),
            F.sum(rr).alias("rr"),
        )
    )
    rate = F.col("top3") / F.col("n")
    base_tags = by_tag.filter(F.col("vector") == baseline).select(
        "tag", rate.alias("base_rate")
    )
    objective = (F.sum("top1") + 0.3 * F.sum("top3") + 0.1 * F.sum("rr")) / F.sum("n")
    summed = (
        by_tag.join(base_tags, "tag", "left")
        .groupBy("vector")
        .agg(
            F.sum("n").alias("cases"),
            (F.sum("top1") / F.sum("n")).alias("top1"),
            (F.sum("top3") / F.sum("n")).alias("top3"),
            (F.sum("rr") / F.sum("n")).alias("mrr"),
            objective.alias("objective"),
            F.bool_and(rate >= F.coalesce("base_rate", F.lit(0.0)) - TAG_TOLERANCE).alias("tags_ok"),
        )
    )
    # A handful of rows, one per vector.
    base = F.max(F.when(F.col("vector") == baseline, F.col("objective"))).over(
        Window.partitionBy(F.lit(0))
    )
    gain = F.col("objective") - F.col("base")
    return summed.withColumn("base", base).select(
        "vector",
        "cases",
        "top1",
        "top3",
        "mrr",
        "objective",
        "tags_ok",
        F.when(F.col("tags_ok") & (gain > ADOPT_MARGIN), "ADOPT").otherwise("KEEP").alias("verdict"),
    )


def jittered_vectors(count: int, seed: int = 1, amount: float = 0.5) -> dict[str, Weights]:
    """A baseline and ``count`` random variations; the recency weight stays,
    since plain cases cannot tell its effect."""
    rng = random.Random(seed)
    base = Weights().as_dict()
    vectors = {"baseline": Weights()}
    for i in range(count):
        varied = {
            k: v if k == "recency" else max(0.0, round(v * (1 + rng.uniform(-amount, amount)), 6))
            for k, v in base.items()
        }
        vectors[f"v{i + 1:03d}"] = Weights(**varied)
    return vectors


def competitors(cases: DataFrame, lexicon: DataFrame, profile: Profile) -> DataFrame:
    """Most frequent form with the input's skeleton that is not expected.

    The two most frequent forms of a skeleton are enough to find it.
    """
    order = [F.desc("freq"), F.col("form_id"), F.col("form")]
    top = F.row_number().over(Window.partitionBy("skel").orderBy(*order))
    pool = (
        with_keys(lexicon, profile)
        .withColumn("_n", top)
        .filter(F.col("_n") <= 2)
        .select("skel", F.col("norm").alias("competitor"), "_n")
    )
    skel = tx.skeleton(tx.normalize(F.col("input"), profile), profile)
    rival = (
        cases.select("case_id", skel.alias("skel"), tx.normalize(F.col("expected"), profile).alias("_exp"))
        .join(pool, "skel")
        .filter(F.col("competitor") != F.col("_exp"))
    )
    return rival.groupBy("case_id").agg(F.min_by("competitor", "_n").alias("competitor"))


def sweep_recency(
    cases: DataFrame,
    known: ex.Knowledge,
    profile: Profile,
    settings: Settings = Settings(),
    grid: Sequence[float] = RECENCY_GRID,
) -> DataFrame:
    """Top-1 rates per recency weight: after the expected word was just used
    (positive), and after a competitor was (adversarial).

    Signals are worked out once; a session of one just-used word only adds a
    recency of 1 to that word.  Compares surface forms.
    """
    queries = as_queries(cases)
    known = with_static(queries, known, profile, settings)
    signals = ex.candidate_signals(ex.prepare_queries(queries, profile), known, profile, settings)
    rivals = competitors(cases, known.lexicon, profile)
    runs = cases.select(
        F.col("case_id"),
        "expected",
        F.lit("positive").alias("run"),
        tx.normalize(F.col("expected"), profile).alias("noted"),
    ).unionByName(
        cases.join(rivals, "case_id").select(
            "case_id", "expected", F.lit("adversarial").alias("run"), F.col("competitor").alias("noted")
        )
    )
    # Of all candidates only the best one and the noted one can come first, for
    # any weight: noting a word raises that word alone.
    base = signals.withColumn(
        "score",
        sc.linear_score(Weights(**{**settings.weights.as_dict(), "recency": 0.0})),
    )
    first = F.struct(
        (-F.col("score")).alias("neg"), F.lit(0).alias("is_oov"), "source_ord",
        (-F.col("freq")).alias("nf"), "form_id", "form", "lemma", "norm",
    )
    unknown = _unknown_targets(
        cases,
        ex.prepare_queries(queries, profile),
        known,
        profile,
        settings,
        runs.filter(F.col("run") == "positive").select(
            F.col("case_id").alias("query_id"), F.col("noted").alias("norm"), F.lit(0.0).alias("recency")
        ),
    ).withColumn("score", sc.linear_score(settings.weights))
    best = base.groupBy(F.col("query_id").alias("case_id")).agg(F.min(first).alias("b"))
    noted = (
        base.select(F.col("query_id").alias("case_id"), F.col("norm").alias("noted"), first.alias("f"))
        .unionByName(
            unknown.select(
                F.col("query_id").alias("case_id"),
                F.col("norm").alias("noted"),
                first.withField("is_oov", F.lit(1)).alias("f"),
            )
        )
        .groupBy("case_id", "noted")
        .agg(F.min("f").alias("n"))
    )
    weights = F.explode(F.array(*[F.lit(float(w)) for w in grid]))

    def raised(s: str, by: Column) -> Column:
        return F.struct(
            F.round(F.col(f"{s}.neg") - by, sc.SCORE_DIGITS).alias("neg"),
            *[F.col(f"{s}.{c}").alias(c) for c in ("is_oov", "source_ord", "nf", "form_id", "form", "lemma")],
        )

    zero = F.lit(0.0)
    w = F.col("w_recency")
    plain = raised("b", F.when(F.col("b.norm") == F.col("noted"), w).otherwise(zero))
    # least() passes over a missing side.
    winner = F.least(F.when(F.col("b").isNotNull(), plain), F.when(F.col("n").isNotNull(), raised("n", w)))
    hit = F.coalesce(F.col("winner.form") == F.col("expected"), F.lit(False)).cast("double")
    rate = F.avg("hit")
    return (
        runs.join(best, "case_id", "left")
        .join(noted, ["case_id", "noted"], "left")
        .select("*", weights.alias("w_recency"))
        .withColumn("winner", winner)
        .withColumn("hit", hit)
        .groupBy("w_recency")
        .pivot("run", ["positive", "adversarial"])
        .agg(rate)
        .withColumn(
            "blend",
            REUSE_SHARE * F.col("positive")
            + (1 - REUSE_SHARE) * F.coalesce("adversarial", F.lit(0.0)),
        )
    )


def aged_sessions(
    cases: DataFrame, lexicon: DataFrame, profile: Profile, noise: int
) -> DataFrame:
    """Sessions ``(case_id, norm, age)`` that used the expected word and then
    ``noise`` other lexicon words; ``age`` counts the words since.

    The other words follow one another in lexicon order from a place given by
    the case's hash, skipping the expected word.
    """
    numbered = row_numbers(
        lexicon, [], lexicon_block(), lexicon_order(), "_at"
    ).select((F.col("_at") - 1).alias("_at"), tx.normalize(F.col("form"), profile).alias("norm"))
    size = lexicon.agg(F.count(F.lit(1))).scalar()
    target = cases.select("case_id", tx.normalize(F.col("expected"), profile).alias("target"))
    # One place more than needed makes up for a skipped expected word.
    slots = target.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(noise)))).withColumn(
        "_at",
        F.pmod(F.floor(tx.uniform("age", F.col("case_id")) * size) + F.col("_k"), size),
    )
    order = Window.partitionBy("case_id").orderBy("_k")
    others = (
        slots.join(numbered, "_at")
        .filter(F.col("norm") != F.col("target"))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= noise)
        .select("case_id", "norm", "_n")
    )
    used = others.unionByName(
        target.select("case_id", F.col("target").alias("norm"), F.lit(0).alias("_n"))
    )
    last = used.groupBy("case_id", "norm").agg(F.max("_n").alias("_n"))
    length = used.groupBy("case_id").agg(F.max("_n").alias("_all"))
    return last.join(length, "case_id").select(
        "case_id", "norm", (F.col("_all") - F.col("_n")).alias("age")
    )


def evaluate_recency(
    cases: DataFrame,
    known: ex.Knowledge,
    profile: Profile,
    noise: int = 0,
    settings: Settings = Settings(),
) -> DataFrame:
    """Cold and warm top-1 and top-3: ``(variant, cases, top1, top3)``.

    Cold has an empty session; warm has used the expected word and ``noise``
    others since.  Expected words that the lexicon lacks are reachable when
    warm, through the session.
    """
    queries = as_queries(cases)
    known = with_static(queries, known, profile, settings)
    prepared = ex.prepare_queries(queries, profile)
    signals = ex.candidate_signals(prepared, known, profile, settings)
    sessions = aged_sessions(cases, known.lexicon, profile, noise).withColumn(
        "recency", sc.recency_prior(F.col("age"), F.lit(0), RECENCY_HALF_LIFE)
    )
    recent = sessions.select(F.col("case_id").alias("query_id"), "norm", "recency")
    warm = (
        signals.drop("s_recency")
        .join(recent, ["query_id", "norm"], "left")
        .withColumn("s_recency", F.coalesce("recency", F.lit(0.0)))
        .drop("recency")
    )
    shown = signals.withColumn("variant", F.lit("cold")).unionByName(
        warm.withColumn("variant", F.lit("warm"))
    )
    shown = shown.unionByName(
        _unknown_targets(cases, prepared, known, profile, settings, recent).withColumn(
            "variant", F.lit("warm")
        ),
        allowMissingColumns=True,
    )
    order = [
        F.desc("score"), F.coalesce("is_oov", F.lit(0)), F.col("source_ord"),
        F.desc("freq"), F.col("form_id"), F.col("form"), F.col("lemma"),
    ]
    best = F.row_number().over(
        Window.partitionBy("query_id", "variant", "norm").orderBy(*order)
    )
    place = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(*order))
    ranked = (
        shown.withColumn("score", sc.linear_score(settings.weights))
        .repartition("query_id")
        .withColumn("_best", best)
        .filter(F.col("_best") == 1)
        .withColumn("rank", place)
        .filter(F.col("rank") <= FLAT_K)
        .select(F.col("query_id").alias("case_id"), "variant", "rank", F.col("form").alias("expected"))
    )
    every = cases.select(
        "case_id", "expected", F.explode(F.array(F.lit("cold"), F.lit("warm"))).alias("variant")
    )
    hit = F.coalesce(F.col("rank") == 1, F.lit(False)).cast("double")
    hit3 = F.coalesce(F.col("rank") <= GROUPS, F.lit(False)).cast("double")
    return (
        every.join(ranked, ["case_id", "variant", "expected"], "left")
        .groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("cases"), F.avg(hit).alias("top1"), F.avg(hit3).alias("top3")
        )
    )


def _unknown_targets(
    cases: DataFrame,
    prepared: DataFrame,
    known: ex.Knowledge,
    profile: Profile,
    settings: Settings,
    recent: DataFrame,
) -> DataFrame:
    """Session candidates of cases whose expected word the lexicon lacks."""
    forms = known.lexicon.select(tx.normalize(F.col("form"), profile).alias("norm")).distinct()
    norm = tx.normalize(F.col("expected"), profile)
    compare = ds.compare_udf(profile, settings)
    near = (
        cases.select(F.col("case_id").alias("query_id"), "expected", norm.alias("norm"))
        .filter(tx.is_plain_word(F.col("norm"), profile))
        .join(forms, "norm", "left_anti")
        .join(prepared, "query_id")
        .withColumn("form_skel", tx.skeleton(F.col("norm"), profile))
        .filter(F.length("norm_input") >= settings.min_input_len)
        .filter(tx.is_plain_word(F.col("norm_input"), profile))
        .filter(
            (F.col("input_skel") != "")
            & (F.left("input_skel", F.lit(1)) == F.left("form_skel", F.lit(1)))
        )
        .withColumn("_c", compare("norm_input", "norm", "input_skel", "form_skel"))
        .filter(F.col("_c.distance") != ds.TOO_FAR)
        .select("*", "_c.*")
        .join(recent, ["query_id", "norm"])
    )
    ready = rt.with_static_signals(
        near.withColumns(
            {
                "form_id": F.lit(0).cast("bigint"),
                "form": F.col("expected"),
                "lemma": F.col("expected"),
                "freq": F.lit(0.0),
                "tags": F.lit(""),
                "source_ord": F.lit(0),
            }
        ),
        extra=["query_id", "prev_key", "recency"],
    )
    scored = ex._context_signal(ready, known, profile)
    return scored.withColumns(
        {
            "s_user": F.lit(0.0),
            "s_morph": F.lit(0.0),
            "s_recency": F.col("recency"),
            "is_oov": F.lit(1),
        }
    ).drop("recency")
