"""Labelled noise: weighted samples of words, shortened the way people do it.

Every random choice is an md5-based number of the seed, the draw and the
position, so a task that runs again makes the same choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unbrev.functions import text as tx
from unbrev.operators.blocked import running_total
from unbrev.profile import Profile

# Chances of each shortening step.
P_TRUNCATE = 0.15
P_KEEP_ENDING = 0.6
P_DROP_VOWEL = 0.75
P_DROP_SIGN = 0.8
P_COLLAPSE = 0.7
P_TYPO = 0.15
MIN_LEN, MIN_VOWELS, MIN_RESULT = 5, 2, 3


def worth_shortening(words: DataFrame, profile: Profile, column: str = "word") -> DataFrame:
    """Words long enough to shorten, with vowels to drop."""
    word = F.col(column)
    vowels = F.length(word) - F.length(F.translate(word, profile.vowels, ""))
    return words.filter((F.length(word) >= MIN_LEN) & (vowels >= MIN_VOWELS))


def weighted_draws(
    items: DataFrame, key: str, weight: Column, count: int, seed: int
) -> DataFrame:
    """``count`` draws with replacement, each item as likely as its weight.

    Items get consecutive stretches of a line as long as their weights; each
    draw is a point on it.  Both sides are cut into ``count`` equal stretches,
    so that finding the item of a point is an equi-join.  Adds ``draw``.
    """
    weighed = items.withColumn("_w", weight.cast("double"))
    block = F.substring(F.md5(F.col(key)), 1, 3)
    placed = running_total(
        weighed, [], [block], [F.md5(F.col(key)), F.col(key)], F.col("_w"), "_hi"
    )
    total = weighed.agg(F.sum("_w")).scalar()
    low = F.greatest((F.col("_hi") - F.col("_w")) / total, F.lit(0.0))
    high = F.col("_hi") / total
    stretched = placed.withColumns({"_low": low, "_high": high}).withColumn(
        "_cell",
        F.explode(
            F.sequence(
                F.floor(F.col("_low") * count), F.least(F.floor(F.col("_high") * count), F.lit(count))
            )
        ),
    )
    draws = items.sparkSession.range(count).select(
        F.col("id").alias("draw"), tx.uniform(str(seed), "draw", F.col("id")).alias("_u")
    )
    pointed = draws.withColumn("_cell", F.floor(F.col("_u") * count))
    return (
        pointed.join(stretched, "_cell")
        .filter((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")))
        .drop("_cell", "_u", "_low", "_high", "_hi", "_w")
    )


def _computed(rows: DataFrame) -> DataFrame:
    """The same rows, with their columns worked out here: later expressions
    that use a column many times would otherwise each repeat all of it."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")


def shorten(draws: DataFrame, profile: Profile, seed: int) -> DataFrame:
    """Add ``input`` and ``tag`` to rows of ``draw, word``.

    Rows whose shortening is too short or leaves the word unchanged are dropped.
    """

    def chance(what: str, *more: Column) -> Column:
        return tx.uniform(str(seed), what, F.col("draw"), F.col("word"), *more)

    word, n = F.col("word"), F.length("word")
    letters = F.split(word, "")
    base = draws.withColumns(
        {
            "_mode": chance("mode"),
            "_keep": chance("keep") < P_KEEP_ENDING,
            "_tail": F.floor(chance("tail") * 2).cast("int") + 2,
            "_typo": chance("typo") < P_TYPO,
        }
    )
    least = F.least(F.lit(4), n - 1)
    cut = F.left(word, (least + F.floor(chance("cut") * (n - least))).cast("int"))
    tail_start = F.greatest(
        n - F.when(F.col("_keep"), F.col("_tail")).otherwise(F.lit(0)), F.lit(1)
    )

    def survives(c: Column, i: Column) -> Column:
        drop_vowel = tx.is_vowel(c, profile) & (
            tx.uniform(str(seed), "vowel", F.col("draw"), word, i) < P_DROP_VOWEL
        )
        drop_sign = tx.is_sign(c, profile) & (
            tx.uniform(str(seed), "sign", F.col("draw"), word, i) < P_DROP_SIGN
        )
        drop_double = (c == F.substring(word, i, F.lit(1))) & (
            tx.uniform(str(seed), "double", F.col("draw"), word, i) < P_COLLAPSE
        )
        return (i == 0) | (i >= tail_start) | ~(drop_vowel | drop_sign | drop_double)

    thin = F.array_join(F.filter(letters, survives), "")
    stripped = _computed(base.withColumn("_thin", thin).withColumn("_cut", cut))
    size = F.length("_thin")
    pos = F.floor(chance("pos") * (size - 2)).cast("int") + 2  # counts from 1
    placed = _computed(
        stripped.withColumn("_pos", pos).withColumn(
            "_near", tx.keyboard_neighbours(F.substring("_thin", F.col("_pos"), F.lit(1)), profile)
        )
    )
    at = F.col("_pos")
    head = F.substring("_thin", F.lit(1), at - 1)
    here = F.substring("_thin", at, F.lit(1))
    after = F.substring("_thin", at + 1, F.lit(1))
    crossed = F.concat(head, after, here, F.substring("_thin", at + 2, size))
    pick = F.floor(chance("near") * F.length("_near")).cast("int") + 1
    missed = F.concat(
        head, F.substring("_near", pick, F.lit(1)), F.substring("_thin", at + 1, size)
    )
    typed = (
        F.when(chance("swap") < 0.5, crossed)
        .when(F.col("_near") != "", missed)
        .otherwise(F.col("_thin"))
    )
    truncated = F.col("_mode") < P_TRUNCATE
    has_typo = F.col("_typo") & (size >= 4)
    usable = (size >= MIN_RESULT) & (size < n)
    return (
        placed.withColumn(
            "input",
            F.when(truncated, F.col("_cut")).when(usable & has_typo, typed).when(usable, F.col("_thin")),
        )
        .withColumn(
            "tag",
            F.when(truncated, "truncate")
            .when(has_typo, "typo")
            .when(F.col("_keep"), "ending")
            .otherwise("skeleton"),
        )
        .filter(F.col("input").isNotNull() & (F.col("input") != word))
        .drop("_mode", "_keep", "_tail", "_typo", "_thin", "_cut", "_pos", "_near")
    )


def synthesize_noisy_pairs(
    lexicon: DataFrame,
    profile: Profile,
    count: int = 10_000,
    seed: int = 42,
    bigrams: DataFrame | None = None,
) -> DataFrame:
    """``(case_id, input, expected, tag, context)`` from a lexicon or, with
    context, from its bigrams.

    Truncations that are words themselves are dropped, since nothing could
    tell what was meant.
    """
    norm = tx.normalize(F.col("form"), profile)
    weight = F.greatest(F.col("freq"), F.lit(0.0)) + 1.0
    pool = worth_shortening(
        lexicon.select(norm.alias("word"), weight.alias("weight")), profile
    )
    if bigrams is None:
        items = pool.groupBy("word").agg(F.sum("weight").alias("weight")).withColumns(
            {"prev": F.lit(""), "_item": F.col("word")}
        )
    else:
        items = bigrams.join(pool.select("word").distinct(), "word", "left_semi").select(
            "word",
            F.col("cnt").cast("double").alias("weight"),
            "prev",
            F.concat_ws(" ", "prev", "word").alias("_item"),
        )
    draws = weighted_draws(items, "_item", F.col("weight"), count, seed)
    noisy = shorten(draws, profile, seed)
    forms = lexicon.select(norm.alias("input"), F.lit(True).alias("is_word")).distinct()
    kept = noisy.join(forms, "input", "left").filter(
        (F.col("tag") != "truncate") | F.col("is_word").isNull()
    )
    none = F.array().cast("array<string>")
    return kept.select(
        F.col("draw").alias("case_id"),
        "input",
        F.col("word").alias("expected"),
        "tag",
        F.when(F.col("prev") != "", F.array("prev")).otherwise(none).alias("context"),
    )
