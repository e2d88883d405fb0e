"""Only candidates that can be among the first of an input are compared and handed on."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from unbrev import LATIN, RU
from unbrev.functions import distance as ds
from unbrev.functions import text as tx
from unbrev.operators import postings as po
from unbrev.operators import retrieve as rt
from unbrev.settings import Settings, Weights

LEX = "form_id bigint, form string, lemma string, freq double, tags string"


def _words(letters: str, count: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    made = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(count)}
    return sorted(made | {w + w[-1] for w in made if len(w) > 3} | {f"{w}-{w[0]}" for w in made if len(w) == 4})


def _lexicon(spark, words):
    rows = [(0, w, w if i % 5 else "ab", float(1 + (i * i) % 97), "") for i, w in enumerate(words)]
    # Homographs: one more row for some forms.
    rows += [(0, w, f"{w}x", 2.0, "") for w in words[::7]]
    return spark.createDataFrame(rows, LEX)


@pytest.mark.parametrize("profile, letters", [(LATIN, "abekrstw"), (RU, "абвёкорстьы")])
def test_sketches_bound_every_pair(spark, profile, letters):
    words = _words(letters, 70, 3)
    norm = tx.normalize(F.col("w"), profile)
    one = spark.createDataFrame([(w,) for w in words], "w string").select(norm.alias("w"), tx.skeleton(norm, profile).alias("k"))
    typed = one.select(F.col("w").alias("norm_input"), F.col("k").alias("input_skel"), *ds.sketch(F.col("w"), F.col("k"), profile, "i_"))
    form = one.select(
        F.col("w").alias("norm"), F.col("k").alias("form_skel"), F.lit(0).alias("form_id"), F.col("w").alias("form"),
        F.col("w").alias("lemma"), F.length("w").cast("double").alias("freq"), F.lit("").alias("tags"), F.lit(0).alias("source_ord"),
        *ds.sketch(F.col("w"), F.col("k"), profile, "f_"),
    )
    settings = Settings(cutoff_base=10_000)
    least = ds.least_distance("i_", "f_", profile, settings.costs)
    pairs = typed.crossJoin(form).withColumns({"least": least, "high": rt.highest_score(profile, settings)})
    compare = ds.compare_udf(profile, settings)
    done = pairs.withColumn("_c", compare("norm_input", "norm", "input_skel", "form_skel")).select("*", "_c.*")
    rows = rt.with_static_signals(done, ["least", "high"]).withColumn("score", rt.static_score(settings)).collect()
    assert len(rows) > 2000
    assert [r for r in rows if r.least > r.distance or r.high < r.score - 1e-9] == []
    assert sum(r.least > 0 for r in rows) > len(rows) / 2


@pytest.mark.parametrize("cap", [None, 2000, 12])
@pytest.mark.parametrize("name", ["form", "lemma"])
def test_leading_candidates_are_the_best_of_all(spark, cap, name):
    settings, limit, slack = Settings(per_source_cap=cap), 2, 0.5
    words = _words("aekrstd", 260, 5) + [f"kr{a}st{b}ed" for a in "aeiou" for b in "aeiour"]
    lexicon = _lexicon(spark, sorted(set(words)))
    asked = spark.createDataFrame([(w,) for w in ["krst", "krsted", "tsk", "rdk", "aed", "zzzz", "kstrd", "x"]], "input string")
    inputs = rt.retrieval_inputs(asked, LATIN, settings)
    postings = po.build_postings(lexicon, LATIN, settings)
    every = rt.scored_candidates(inputs, postings, LATIN, settings).withColumn("score", rt.static_score(settings)).collect()
    got = rt.leading_candidates(inputs, postings, LATIN, settings, name, limit, slack, slice_rows=50).collect()

    def shown(r):
        return r.norm_input, r.form, r.lemma, r.source_ord, r.distance, r.s_skeleton, r.s_prefix, r.s_freq

    want = []
    for typed in {r.norm_input for r in every}:
        mine = [r for r in every if r.norm_input == typed]
        best = {}
        for r in mine:
            best[r[name]] = max(best.get(r[name], r.score), r.score)
        bars = sorted(best.values(), reverse=True)
        want += [r for r in mine if len(bars) < limit or r.score >= bars[limit - 1] - slack]
    kept = set(map(shown, got))
    assert len(kept) == len(got) and set(map(shown, want)) <= kept <= set(map(shown, every))
    # Those that cannot be among the first are not handed on.
    assert len(got) < len(every) * 0.7


def test_weights_that_reward_distance_are_not_bounded():
    assert rt.can_lead(Settings()) and not rt.can_lead(Settings(weights=Weights(edit=-1.0)))
