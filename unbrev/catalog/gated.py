"""Registered queries over load order, gated masks, government, scorers and SQL functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unbrev.catalog import corpus, ranking, sessions
from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import P, base_lexicon, conversation_words, lemma_lexicon, shorthand_queries, toxic_words, word_counts
from unbrev.catalog.ranking import FLAT, GROUP_LIMIT, LIMIT, _show
from unbrev.functions import text as tx
from unbrev.functions.sql import register_functions
from unbrev.operators.lexicons import in_load_order, with_keys
from unbrev.plans import expand as ex
from unbrev.plans import masking
from unbrev.plans import sessions as se
from unbrev.plans.signals import batch_scorer
from unbrev.profile import CASES
from unbrev.session import settle

# Words of the test texts that stand for prepositions, and their cases.
GOVERNMENT = (
    ("the", "nomn"), ("the", "accs"), ("of", "gent"), ("in", "loct"), ("in", "accs"), ("with", "ablt"), ("le", "datv"),
    ("la", "gent"), ("der", "datv"), ("die", "accs"), ("el", "nomn"), ("que", "loct"), ("to", "datv"), ("and", "ablt"),
)


def homographs_in_load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources with homographs of equal frequency: the words of the conversations,
    under another lemma, are loaded before the documents' lexicon."""
    base = base_lexicon(spark, sf_dir)
    used = word_counts(spark, sf_dir, "conversations").select(F.col("word").alias("form"))
    first = base.join(used, "form", "left_semi").withColumn("lemma", F.concat("form", F.lit("-x")))
    lexicon = in_load_order(first, base)
    place = F.row_number().over(Window.partitionBy("skel").orderBy(F.desc("freq"), "form_id"))
    return with_keys(lexicon, P).select(
        "form", "lemma", "freq", "form_id", place.cast("bigint").alias("place")
    )


def _registers(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """Each of ``words (query_id)`` where it stands in a conversation for the first time,
    with the register just before: ``(word, query_id, register)``."""
    track = settle(se.session_features(conversation_words(spark, sf_dir), sessions.markers(spark), P))
    asks = (
        track.filter("is_plain")
        .groupBy("session_id", F.col("norm").alias("word"))
        .agg((F.min("tick") - 1).alias("tick"))
        .join(words.select(F.col("query_id").alias("word")), "word")
    )
    return masking.register_as_of(track, asks).select(
        "word", F.concat_ws(" ", "session_id", "word").alias("query_id"), "register"
    )


def _gated(spark: SparkSession, sf_dir: str, rows: DataFrame, limit: int, grouped: bool) -> DataFrame:
    rows = settle(rows)
    asked = settle(_registers(spark, sf_dir, shorthand_queries(spark, sf_dir)))
    own = rows.withColumnRenamed("query_id", "word").join(asked.select("word", "query_id"), "word").drop("word")
    twins = masking.mask_expansions(
        own, toxic_words(spark, sf_dir), P, limit, asked.select("query_id", "register"), True, grouped
    )
    return _show(twins, "query_id", "rank", "form", "lemma", "score", "is_twin")


def masked_when_polite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words asked within conversations; twins in polite stretches only."""
    known = ex.Knowledge(base_lexicon(spark, sf_dir))
    rows = ex.expand_tokens(shorthand_queries(spark, sf_dir), known, P, limit=LIMIT)
    return _gated(spark, sf_dir, rows, LIMIT, False)


def masked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over lemma groups."""
    known = ex.Knowledge(lemma_lexicon(spark, sf_dir))
    rows = ex.expand_tokens_grouped(shorthand_queries(spark, sf_dir), known, P, limit=GROUP_LIMIT)
    return _gated(spark, sf_dir, rows, GROUP_LIMIT, True)


def tagged_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lexicon with a case in every tag, by the length of the word."""
    cases = F.array(*[F.lit(c) for c in CASES])
    case = F.get(cases, F.length("form") % len(CASES))
    return base_lexicon(spark, sf_dir).withColumn("tags", F.concat(F.lit("NOUN,sing "), case))


def ranked_government(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in context, ranked with the cases that the word before governs."""
    rules = spark.createDataFrame(list(GOVERNMENT), "prep string, case string")
    known = ex.Knowledge(settle(tagged_lexicon(spark, sf_dir)), government=rules)
    return _show(ex.expand_tokens(ranking.context_queries(spark, sf_dir), known, P, limit=LIMIT), *FLAT)


def rhyme(contexts: pa.Array, forms: pa.Array, lemmas: pa.Array) -> np.ndarray:
    """A caller's scorer: 2.5 for forms that end with the last letter of the word before."""
    before = pc.utf8_slice_codeunits(pc.list_element(contexts, 0), -1, None)
    same = pc.equal(before, pc.utf8_slice_codeunits(forms, -1, None))
    return np.where(pc.fill_null(same, False).to_numpy(zero_copy_only=False), 2.5, 0.0)


def ranked_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in context, ranked with a caller's own context scorer."""
    known = ex.Knowledge(base_lexicon(spark, sf_dir), context_scorer=batch_scorer(rhyme))
    return _show(ex.expand_tokens(ranking.context_queries(spark, sf_dir), known, P, limit=LIMIT), *FLAT)


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every word by the functions registered for SQL text."""
    register_functions(spark, P)
    word_counts(spark, sf_dir).createOrReplaceTempView("unbrev_words")
    return spark.sql(
        "SELECT word, word_skeleton(word_normalize(word)) AS skel, "
        "array_join(array_sort(word_deletes(word_skeleton(word))), ' ') AS deletes, "
        "word_distance(word_skeleton(word), word) AS distance FROM unbrev_words WHERE length(word_skeleton(word)) > 0"
    )


_MASKED = (
    "asks",
    "SELECT f.session_id || ' ' || f.norm AS query_id, f.norm AS word, "
    f"coalesce({sessions._REGISTER}, 'neutral') AS register FROM "
    "(SELECT session_id, norm, min(pos) AS pos FROM ct WHERE is_plain GROUP BY ALL) f "
    "LEFT JOIN tone t ON t.session_id = f.session_id AND t.pos = f.pos - 1",
)


def _masked_sql(top: str, limit: int, seen: str) -> list[tuple[str, str]]:
    mask = corpus.mask_sql("form")
    return [
        *sessions._WORDS,
        sessions._MARKS,
        sessions._TONE,
        _MASKED,
        corpus.TOXIC,
        ("top", top),
        (
            "shown",
            "SELECT a.query_id, a.register, t.rank, t.score, t.form, t.lemma FROM asks a JOIN top t ON t.query_id = a.word",
        ),
        (
            "twins",
            "SELECT query_id, rank, score, form, lemma, 0 AS is_twin FROM shown UNION ALL "
            f"SELECT query_id, rank, score, {mask}, {mask}, 1 FROM shown WHERE register = 'polite' "
            f"AND lemma IN (SELECT lemma FROM toxic) AND {mask} IS NOT NULL",
        ),
        (
            "kept",
            f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {seen} ORDER BY rank, is_twin) AS nth FROM twins) "
            "WHERE is_twin = 0 OR nth = 1",
        ),
        (
            "placed",
            "SELECT query_id, r AS rank, form, lemma, score, is_twin FROM (SELECT * EXCLUDE (rank), row_number() OVER "
            f"(PARTITION BY query_id ORDER BY rank, is_twin) AS r FROM kept) WHERE r <= {limit}",
        ),
    ]


def _context_sql(signal: dict[str, str]) -> str:
    return (
        o.with_(
            *o.lex(),
            *ranking._CONTEXT_QUERIES,
            *o.static_signals(),
            (
                "scored",
                f"SELECT q.query_id, s.form, s.lemma, s.freq, s.source_ord, {o.score(signal)} AS score FROM qs q JOIN sig s USING (norm_input)",
            ),
        )
        + ranking._FLAT_TOP
    )


_RULES = ", ".join(f"('{prep}', '{case}')" for prep, case in GOVERNMENT)
_CASE = f"{list(CASES)}[length(s.form) % {len(CASES)} + 1]"

SQL = {
    "homographs_in_load_order": o.with_(
        *o.lex(),
        o.counts("conv", "conversations"),
        (
            "both_sources",
            "SELECT form, form || '-x' AS lemma, freq, skel, 0 AS source FROM lex WHERE form IN (SELECT word FROM conv) "
            "UNION ALL SELECT form, lemma, freq, skel, 1 FROM lex",
        ),
        ("numbered", "SELECT *, row_number() OVER (ORDER BY source, freq DESC, form) AS form_id FROM both_sources"),
    )
    + "SELECT form, lemma, freq, form_id, row_number() OVER (PARTITION BY skel ORDER BY freq DESC, form_id) AS place FROM numbered",
    "masked_when_polite": o.with_(
        *ranking._RANK, ranking._scored(), *_masked_sql(ranking._FLAT_TOP, LIMIT, "form")
    )
    + "SELECT * FROM placed",
    "masked_groups": o.with_(
        *ranking._RANK,
        ranking._scored(),
        *ranking._GROUPED,
        *_masked_sql(
            "SELECT query_id, r AS rank, form, lemma, round(score, 6) AS score FROM groups", GROUP_LIMIT, "form, is_twin"
        ),
    )
    + "SELECT * FROM placed",
    "ranked_government": _context_sql(
        {"morph": f"(CASE WHEN (q.prev, {_CASE}) IN (VALUES {_RULES}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"}
    ),
    "ranked_scorer": _context_sql(
        {"context": "(CASE WHEN q.prev <> '' AND right(q.prev, 1) = right(s.form, 1) THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END)"}
    ),
    "sql_functions": o.with_(
        o.counts("c", "documents"),
        ("keyed", f"SELECT word, {o.skel('word')} AS skel FROM c"),
        ("pairs", "SELECT skel AS norm_input, word AS form FROM keyed WHERE skel <> ''"),
        *o.distances("pairs"),
    )
    + f"SELECT word, skel, array_to_string(list_sort({o.deletes('skel')}), ' ') AS deletes, d AS distance "
    "FROM keyed JOIN dist ON a = skel AND b = word",
}
RUN = {name: globals()[name] for name in SQL}
