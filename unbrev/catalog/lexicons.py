"""Registered queries that enrich lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import (
    P,
    base_lexicon,
    inflected_paradigms,
    lemma_lexicon,
    stem_table,
    word_counts,
)
from unbrev.catalog.ranking import PARADIGMS
from unbrev.functions import text as tx
from unbrev.plans import lexicon as lx
from unbrev.profile import CASES


def balanced_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation words as a frequency dictionary; short ones count as
    prepositions, which is what calibration looks at."""
    counts = word_counts(spark, sf_dir, "conversations")
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.select(
        F.col("word").alias("lemma"),
        F.when(F.length("word") <= 4, "pr").otherwise("s").alias("pos"),
        (F.col("cnt") * 1e6 / total).alias("ipm"),
    )


def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lx.calibrate_frequencies(
        base_lexicon(spark, sf_dir), balanced_dictionary(spark, sf_dir), P
    )
    return done.select("form", "freq", "raised")


def lemma_frequency_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.lemma_frequency_range(lemma_lexicon(spark, sf_dir), P)


def expand_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    added = lx.expand_paradigm_forms(lex, inflected_paradigms(lex), P)
    return added.select("form", "lemma", "freq", "tags")


def lemmatized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemma_lexicon(spark, sf_dir).select("form", "lemma", "freq", "tags")


def build_paradigms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paradigms of lexicon words from a table of their attested endings: each
    known ending is one case, and frequent words count as adjectives too."""
    lex = base_lexicon(spark, sf_dir)
    case = F.element_at(
        F.array(*[F.lit(c) for c in CASES]), F.length("tags").cast("int") % 6 + 1
    )
    table = stem_table(lex).select(
        "lemma",
        F.when(F.col("score") >= 50, "ADJF").otherwise("NOUN").alias("pos"),
        F.when(F.col("tags").endswith("n"), "plur").otherwise("sing").alias("number"),
        F.lit("masc").alias("gender"),
        case.alias("case"),
        F.when(F.col("form").startswith("t"), "anim").otherwise("inan").alias("animacy"),
        "form",
    )
    return lx.build_paradigms(lex.select("lemma"), table)


def build_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names: lexicon words that start with each vowel-free pair, declined with
    the ending table; every third letter count is a surname."""
    return _names(base_lexicon(spark, sf_dir))


def _names(lex: DataFrame) -> DataFrame:
    kind = F.when(F.length("form") % 3 == 0, "surname").otherwise("first")
    names = lex.select(F.col("form").alias("name"), kind.alias("kind"))
    case = F.element_at(F.array(*[F.lit(c) for c in CASES]), F.col("case_ord"))
    inflections = inflected_paradigms(lex).select(
        F.col("lemma").alias("name"),
        F.when(F.length("lemma") % 3 == 0, "surname").otherwise("first").alias("kind"),
        "lemma",
        "number",
        case.alias("case"),
        "form",
        F.concat_ws(",", F.lit("NOUN,Name"), "number", case).alias("tags"),
    )
    return lx.build_names(names, inflections).select("form", "lemma", "freq", "tags")


def corpus_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function-word floor of the conversations' dictionary."""
    floor = lx.function_word_floor(balanced_dictionary(spark, sf_dir), P)
    return floor.withColumn("ipm", F.round("ipm", 6))


def appended_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon with the names folded in; homographs stay apart."""
    lex = base_lexicon(spark, sf_dir)
    names = _names(lex).withColumn("form_id", F.lit(0).cast("bigint"))
    merged = lx.append_lexicon(lex, names)
    key = tx.normalize(F.col("form"), P)
    return merged.groupBy(key.alias("norm")).agg(
        F.count(F.lit(1)).alias("entries"), F.max("freq").alias("top_freq")
    )


_DICT = [
    o.counts("ccounts", "conversations"),
    (
        "floors",
        "SELECT word AS norm, sum(cnt * 1e6::DOUBLE / (SELECT sum(cnt) FROM ccounts)) AS ipm FROM ccounts WHERE length(word) <= 4 GROUP BY word",
    ),
]
_ENDING_ROWS = ", ".join(f"('{e}')" for e in P.endings)
_STEMS = (
    "stems",
    "SELECT l.form, s.form AS lemma, 'end,' || e.ending AS tags, s.freq AS score FROM lex l "
    f"JOIN (VALUES {_ENDING_ROWS}) e(ending) ON ends_with(l.form, e.ending) "
    "JOIN lex s ON s.form = left(l.form, length(l.form) - length(e.ending))",
)
_LEMMATIZED = (
    "lemmatized",
    "SELECT l.form, coalesce(m.lemma, l.lemma) AS lemma, l.freq, coalesce(m.tags, '') AS tags FROM lex l LEFT JOIN "
    "(SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, lemma DESC, tags DESC) AS r FROM stems) m "
    "ON m.form = l.form AND m.r = 1",
)
_TAG_CASE = "['nomn','gent','datv','accs','ablt','loct']"
_NAMES = (
    "names",
    "SELECT form, lemma, 1.0::DOUBLE AS freq, arg_min(tags, place) AS tags FROM (SELECT "
    "array_to_string(list_transform(string_split(form, '-'), lambda s: upper(left(s, 1)) || substr(s, 2)), '-') AS form, "
    "array_to_string(list_transform(string_split(lemma, '-'), lambda s: upper(left(s, 1)) || substr(s, 2)), '-') AS lemma, "
    f"'NOUN,Name,' || number || ',' || {_TAG_CASE}[case_ord] AS tags, CASE number WHEN 'sing' THEN 0 ELSE 10 END + case_ord AS place "
    "FROM paradigms WHERE number = 'sing' OR length(lemma) % 3 = 0) GROUP BY form, lemma",
)

SQL = {
    "calibrate": o.with_(
        *o.lex(),
        *_DICT,
        (
            "scale",
            "SELECT sum(freq) AS total FROM lex WHERE form NOT IN (SELECT norm FROM floors)",
        ),
    )
    + "SELECT form, CASE WHEN target > freq THEN target ELSE freq END AS freq, coalesce(target > freq, false) AS raised FROM ("
    "SELECT l.form, l.freq, floor(f.ipm * (SELECT total FROM scale) / 1e6::DOUBLE + 0.5::DOUBLE) AS target FROM lex l LEFT JOIN floors f ON f.norm = l.form)",
    "corpus_dictionary": o.with_(*_DICT) + "SELECT norm, round(ipm, 6) AS ipm FROM floors",
    "lemmatized": o.with_(*o.lex(), _STEMS, _LEMMATIZED) + "SELECT * FROM lemmatized",
    "lemma_frequency_range": o.with_(*o.lex(), _STEMS, _LEMMATIZED)
    + "SELECT lemma, max(freq) AS max_freq, min(freq) AS min_freq FROM lemmatized GROUP BY lemma",
    "expand_forms": o.with_(
        *o.lex(),
        PARADIGMS,
        (
            "missing",
            "SELECT p.*, l.freq FROM paradigms p JOIN lex l ON l.form = p.lemma WHERE p.form NOT IN (SELECT form FROM lex) "
            "AND floor(l.freq) - 1 >= 1",
        ),
    )
    + "SELECT form, lemma, least(greatest(floor(freq * 0.25::DOUBLE + 0.5::DOUBLE), 1), floor(freq) - 1)::DOUBLE AS freq, "
    f"'NOUN ' || arg_min(number, (number, case_ord)) || ',' || {_TAG_CASE}[arg_min(case_ord, (number, case_ord))] AS tags "
    "FROM missing GROUP BY form, lemma, freq",
    "build_paradigms": o.with_(
        *o.lex(),
        _STEMS,
        (
            "infl",
            f"SELECT lemma, CASE WHEN score >= 50 THEN 'ADJF' ELSE 'NOUN' END AS pos, CASE WHEN ends_with(tags, 'n') THEN 'plur' "
            f"WHEN score >= 50 THEN 'sing.masc' ELSE 'sing' END AS grp, {_TAG_CASE}[length(tags) % 6 + 1] AS c, form, "
            "starts_with(form, 't') AS anim FROM stems",
        ),
        (
            "cells",
            "SELECT lemma, grp, c, arg_min(form, (pos = 'ADJF' AND anim, form)) AS form FROM infl GROUP BY ALL",
        ),
    )
    + "SELECT lemma, grp, "
    + ", ".join(f"coalesce(max(form) FILTER (c = '{c}'), '') AS {c}" for c in CASES)
    + " FROM cells GROUP BY lemma, grp",
    "build_names": o.with_(*o.lex(), PARADIGMS, _NAMES) + "SELECT form, lemma, freq, tags FROM names",
    "appended_lexicon": o.with_(*o.lex(), PARADIGMS, _NAMES)
    + "SELECT norm, count(*) AS entries, max(freq) AS top_freq FROM (SELECT form AS norm, freq FROM lex UNION ALL "
    "SELECT lower(form), freq FROM names) GROUP BY norm",
}
RUN = {name: globals()[name] for name in SQL}
