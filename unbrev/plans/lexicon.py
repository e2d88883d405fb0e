"""Jobs that build and enrich lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unbrev.functions import text as tx
from unbrev.operators.lexicons import LEXICON_COLUMNS
from unbrev.profile import CASES, Profile

# Closed word classes whose form is the lemma, and the longest
# word whose frequency is corrected.
FUNCTION_CLASSES = ("conj", "pr", "part", "intj", "advpro")
CALIBRATE_MAX_LEN = 4
EXPAND_RATIO = 0.25


def build_lexicon(
    raw: DataFrame, profile: Profile, min_freq: float = 0.0
) -> DataFrame:
    """Lexicon from raw ``(form, lemma, freq)`` rows.

    Each normalised form keeps the lemma and frequency of its most frequent
    row; of equal rows the first, if the input has a ``line_id``.
    """
    line = F.col("line_id") if "line_id" in raw.columns else F.lit(0)
    best = F.max_by(
        F.struct("lemma", "freq"), F.struct("freq", (-line).alias("early"), "lemma")
    )
    return (
        raw.filter(F.col("freq") >= min_freq)
        .filter(tx.is_lexicon_word(F.col("form"), profile))
        .groupBy(tx.normalize(F.col("form"), profile).alias("form"))
        .agg(best.alias("b"))
        .select(
            F.lit(0).cast("bigint").alias("form_id"),
            "form",
            tx.normalize(F.col("b.lemma"), profile).alias("lemma"),
            F.col("b.freq").cast("double").alias("freq"),
            F.lit("").alias("tags"),
        )
    )


def lexicon_from_counts(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """Lexicon of already normalised words, each its own lemma."""
    return counts.filter(F.col("cnt") >= min_count).select(
        F.lit(0).cast("bigint").alias("form_id"),
        F.col("word").alias("form"),
        F.col("word").alias("lemma"),
        F.col("cnt").cast("double").alias("freq"),
        F.lit("").alias("tags"),
    )


def append_lexicon(base: DataFrame, *extra: DataFrame) -> DataFrame:
    """Fold more sources in; homographs stay separate rows.

    Load positions of a later source come after those of an earlier one.
    """
    merged = base.select(*LEXICON_COLUMNS)
    for source_ord, more in enumerate(extra, start=1):
        shifted = more.withColumn(
            "form_id", F.col("form_id") + F.lit(source_ord).cast("bigint") * (1 << 54)
        )
        merged = merged.unionByName(shifted.select(*LEXICON_COLUMNS))
    return merged


def function_word_floor(
    dictionary: DataFrame, profile: Profile, max_len: int = CALIBRATE_MAX_LEN
) -> DataFrame:
    """``(norm, ipm)`` of short function words of a corpus dictionary."""
    norm = tx.normalize(F.col("lemma"), profile)
    return (
        dictionary.filter(tx.strip(F.col("pos")).isin(*FUNCTION_CLASSES))
        .filter(F.length(norm) <= max_len)
        .groupBy(norm.alias("norm"))
        .agg(F.sum("ipm").alias("ipm"))
    )


def calibrate_frequencies(
    lexicon: DataFrame,
    dictionary: DataFrame,
    profile: Profile,
    max_len: int = CALIBRATE_MAX_LEN,
) -> DataFrame:
    """Raise short function words to their corpus frequency, never lower.

    The scale comes from the words that are not corrected, so a second run
    changes nothing.  Adds a ``raised`` flag.
    """
    floor = function_word_floor(dictionary, profile, max_len)
    keyed = lexicon.withColumn("norm", tx.normalize(F.col("form"), profile))
    total = keyed.join(floor, "norm", "left_anti").agg(F.sum("freq")).scalar()
    # floor(x + 0.5) rounds halves up, as positive values need it.
    target = F.floor(F.col("ipm") * total / 1e6 + 0.5).cast("double")
    raised = F.coalesce((total > 0) & (target > F.col("freq")), F.lit(False))
    return (
        keyed.join(floor, "norm", "left")
        .withColumn("raised", raised)
        .withColumn("freq", F.when(raised, target).otherwise(F.col("freq")))
        .select(*LEXICON_COLUMNS, "raised")
    )


def lemma_frequency_range(lexicon: DataFrame, profile: Profile) -> DataFrame:
    """``(lemma, max_freq, min_freq)`` over the forms present."""
    return lexicon.groupBy(tx.normalize(F.col("lemma"), profile).alias("lemma")).agg(
        F.max("freq").alias("max_freq"), F.min("freq").alias("min_freq")
    )


def expand_paradigm_forms(
    lexicon: DataFrame,
    paradigms: DataFrame,
    profile: Profile,
    ratio: float = EXPAND_RATIO,
) -> DataFrame:
    """Missing paradigm forms of lemmas the lexicon has, as new lexicon rows.

    A new form gets a share of the lemma's highest frequency, kept below its
    lowest, so that real forms always stay ahead.
    """
    spread = lemma_frequency_range(lexicon, profile)
    upper = F.floor(F.col("min_freq")) - 1
    fill = F.least(
        F.greatest(F.floor(F.col("max_freq") * ratio + 0.5), F.lit(1)), upper
    )
    cells = paradigms.select(
        tx.normalize(F.col("lemma"), profile).alias("lemma"),
        "number",
        "gender",
        "case_ord",
        tx.normalize(F.col("form"), profile).alias("form"),
    ).filter(F.col("form") != "")
    adjectives = cells.groupBy("lemma").agg(
        F.max(F.col("gender").isNotNull()).alias("is_adj")
    )
    case = F.element_at(F.array(*[F.lit(c) for c in CASES]), F.col("case_ord"))
    tag = (
        F.when(
            F.col("is_adj") & F.col("gender").isNotNull(),
            F.concat(F.lit("ADJF "), "gender", F.lit(",sing,"), case),
        )
        .when(F.col("is_adj"), F.concat(F.lit("ADJF plur,"), case))
        .otherwise(F.concat(F.lit("NOUN "), "number", F.lit(","), case))
    )
    present = lexicon.select(tx.normalize(F.col("form"), profile).alias("form"))
    # A form that fills several cells keeps the tag of the first one, in the
    # order in which the groups are listed in the sorted artifact.
    group_name = F.concat_ws(".", "number", "gender")
    first = F.min(F.struct(group_name.alias("g"), "case_ord", tag.alias("tags")))
    # Cells are many times the lexicon, whatever the planner takes their size to be, and
    # must not be broadcast.
    return (
        cells.hint("merge")
        .join(spread.filter(upper >= 1), "lemma")
        .join(present, "form", "left_anti")
        .join(adjectives.hint("merge"), "lemma")
        .groupBy("lemma", "form")
        .agg(first.alias("f"), F.first(fill).alias("fill"))
        .select(
            F.lit(0).cast("bigint").alias("form_id"),
            "form",
            "lemma",
            F.col("fill").cast("double").alias("freq"),
            F.col("f.tags").alias("tags"),
        )
    )


def lemmatize_lexicon(lexicon: DataFrame, morph: DataFrame, profile: Profile) -> DataFrame:
    """Lemma and tags from the most probable row of a morphology table.

    ``morph`` has ``form, lemma, tags, score``; forms without a row keep what
    they had.
    """
    best = F.max_by(F.struct("lemma", "tags"), F.struct("score", "lemma", "tags"))
    picked = (
        morph.groupBy(tx.normalize(F.col("form"), profile).alias("norm"))
        .agg(best.alias("m"))
    )
    return (
        lexicon.withColumn("norm", tx.normalize(F.col("form"), profile))
        .join(picked, "norm", "left")
        .select(
            "form_id",
            "form",
            F.coalesce("m.lemma", "lemma").alias("lemma"),
            "freq",
            F.coalesce("m.tags", "tags").alias("tags"),
        )
    )


def build_paradigms(lemmas: DataFrame, inflections: DataFrame) -> DataFrame:
    """Paradigm rows ``(lemma, grp, nomn .. loct)`` of the lemmas.

    ``inflections`` has ``lemma, pos, number, gender, case, animacy, form``.
    A lemma that is both noun and adjective counts as a noun; adjectives take
    the inanimate accusative; groups without any form are left out.
    """
    known = lemmas.select("lemma").distinct()
    rows = inflections.filter(F.col("pos").isin("NOUN", "ADJF")).join(
        known, "lemma", "left_semi"
    )
    kind = rows.groupBy("lemma").agg(F.max("pos").alias("pos"))
    # "NOUN" sorts after "ADJF", so the maximum is the noun reading.
    group = F.when(
        (F.col("pos") == "ADJF") & (F.col("number") == "sing"),
        F.concat(F.lit("sing."), F.col("gender")),
    ).otherwise(F.col("number"))
    preferred = F.min_by(
        "form",
        F.struct(
            ((F.col("pos") == "ADJF") & (F.col("animacy") == "anim")).alias("anim"),
            F.col("form"),
        ),
    )
    return (
        rows.join(kind, ["lemma", "pos"], "left_semi")
        .filter(F.coalesce(F.col("form"), F.lit("")) != "")
        .withColumn("grp", group)
        .groupBy("lemma", "grp")
        .pivot("case", list(CASES))
        .agg(preferred)
        .fillna("", list(CASES))
    )


def build_names(
    names: DataFrame, inflections: DataFrame, freq: float = 1.0
) -> DataFrame:
    """Lexicon rows of declined names, all at one low frequency.

    ``names`` has ``name, kind`` (first, surname, patronymic); ``inflections``
    has ``name, kind, lemma, number, case, form, tags``.  Only surnames have a
    plural.  A form that fills several cells keeps the first one's tags.
    """
    order = F.array(*[F.lit(c) for c in CASES])
    first = F.min_by(
        "tags",
        F.struct(
            F.when(F.col("number") == "sing", 0).otherwise(1).alias("n"),
            F.array_position(order, F.col("case")).alias("c"),
        ),
    )
    # Neither side is broadcast: both grow with the lexicon, and cells that are exploded are
    # taken to be as few as the words they come from.
    return (
        names.select(F.lower("name").alias("name"), "kind")
        .distinct()
        .hint("merge")
        .join(inflections.withColumn("name", F.lower("name")).hint("merge"), ["name", "kind"])
        .filter((F.col("number") == "sing") | (F.col("kind") == "surname"))
        .groupBy(
            tx.title_case_name(F.col("form")).alias("form"),
            tx.title_case_name(F.col("lemma")).alias("lemma"),
        )
        .agg(first.alias("tags"))
        .select(
            F.lit(0).cast("bigint").alias("form_id"),
            "form",
            "lemma",
            F.lit(float(freq)).alias("freq"),
            "tags",
        )
    )


def paradigm_grid(paradigms: DataFrame) -> DataFrame:
    """Nested view: one row per lemma with ordered groups of (case, form).

    ``paradigms`` is the long table of :func:`unbrev.sources.readers.read_paradigms`;
    a lemma has at most four groups of six cells, so the arrays are bounded.
    """
    case = F.element_at(F.array(*[F.lit(c) for c in CASES]), F.col("case_ord"))
    number_rank = F.when(F.col("number") == "sing", 0).otherwise(1)
    gender_rank = F.coalesce(
        F.array_position(
            F.array(F.lit("masc"), F.lit("femn"), F.lit("neut")), F.col("gender")
        ),
        F.lit(0),
    )
    groups = (
        paradigms.groupBy(
            "lemma", "number", "gender", number_rank.alias("nr"), gender_rank.alias("gr")
        )
        .agg(
            F.sort_array(
                F.collect_list(F.struct("case_ord", case.alias("case"), "form"))
            ).alias("cells")
        )
        .withColumn(
            "forms",
            F.transform("cells", lambda c: F.struct(c["case"].alias("case"), c["form"].alias("form"))),
        )
    )
    return groups.groupBy("lemma").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("nr", "gr", "number", "gender", "forms"))),
            lambda g: F.struct(
                g["number"].alias("number"),
                g["gender"].alias("gender"),
                g["forms"].alias("forms"),
            ),
        ).alias("groups")
    )


def paradigm_forms(paradigms: DataFrame) -> DataFrame:
    """``(lemma, ord, form)`` in canonical order, repeats dropped.

    A lemma has at most 24 cells, so the window per lemma is small.
    """
    number_rank = F.when(F.col("number") == "sing", 0).otherwise(1)
    gender_rank = F.coalesce(
        F.array_position(
            F.array(F.lit("masc"), F.lit("femn"), F.lit("neut")), F.col("gender")
        ),
        F.lit(0),
    )
    place = number_rank * 100 + gender_rank * 10 + F.col("case_ord")
    firsts = paradigms.groupBy("lemma", "form").agg(F.min(place).alias("place"))
    rank = F.row_number().over(Window.partitionBy("lemma").orderBy("place"))
    return firsts.select("lemma", rank.alias("ord"), "form")
