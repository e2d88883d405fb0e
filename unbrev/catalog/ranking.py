"""Registered queries over ranked expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unbrev.catalog import corpus
from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import (
    P,
    base_lexicon,
    inflected_paradigms,
    lemma_lexicon,
    shorthand,
    shorthand_queries,
    table,
    toxic_words,
)
from unbrev.functions import text as tx
from unbrev.plans import expand as ex
from unbrev.plans import lexicon as lx
from unbrev.session import settle

LIMIT, GROUP_LIMIT = 5, 3
SCORE_DIGITS = 6


def _show(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.withColumns(
        {
            "score": F.round("score", SCORE_DIGITS),
            "rank": F.col("rank").cast("bigint"),
        }
    ).select(*cols)


FLAT = ("query_id", "rank", "form", "lemma", "score", "source")


def ranked_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ex.Knowledge(base_lexicon(spark, sf_dir))
    return _show(ex.expand_tokens(shorthand_queries(spark, sf_dir), known, P, limit=LIMIT), *FLAT)


def ranked_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ex.Knowledge(lemma_lexicon(spark, sf_dir))
    groups = ex.expand_tokens_grouped(
        shorthand_queries(spark, sf_dir), known, P, limit=GROUP_LIMIT
    )
    return _show(groups, *FLAT)


def group_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lemma_lexicon(spark, sf_dir)
    groups = ex.expand_tokens_grouped(
        shorthand_queries(spark, sf_dir), ex.Knowledge(lex), P, limit=GROUP_LIMIT
    )
    variants = ex.group_variants(groups, ex.forms_of_lemma(lex, P), P)
    return ex.nest_variants(groups, variants).select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "lemma",
        "form",
        F.array_join("variants", " ").alias("variants"),
    )


def context_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (previous word, word) of the benchmark passages, as shorthand."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(tx.tokens_with_context(F.col("text"), P, 1)).alias("w")
    )
    word = tx.normalize(F.col("w.token"), P)
    prev = tx.last_context_key(F.col("w.context"), P)
    return (
        words.select(prev.alias("prev"), word.alias("word"))
        .distinct()
        .select(
            F.concat_ws(" ", "prev", "word").alias("query_id"),
            shorthand(F.col("word")).alias("input"),
            F.array("prev").alias("context"),
        )
    )


def ranked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = settle(corpus.pmi(spark, sf_dir))
    known = ex.Knowledge(base_lexicon(spark, sf_dir), pmi=pairs)
    return _show(ex.expand_tokens(context_queries(spark, sf_dir), known, P, limit=LIMIT), *FLAT)


def shortcut_table(lex: DataFrame) -> DataFrame:
    """Shorthands of the most frequent words: every lexicon word of at least
    100 uses, keyed by its shorthand, most frequent first."""
    frequent = lex.filter("freq >= 100")
    key = shorthand(F.col("form"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("freq"), "form"))
    return frequent.withColumn("key", key).select(
        "key", place.alias("ord"), F.upper("form").alias("form"), F.col("form").alias("lemma")
    )


def ranked_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    known = ex.Knowledge(lex, shortcuts=shortcut_table(lex))
    return _show(ex.expand_tokens(shorthand_queries(spark, sf_dir), known, P, limit=LIMIT), *FLAT)


def ranked_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ex.Knowledge(base_lexicon(spark, sf_dir))
    rows = ex.expand_tokens(shorthand_queries(spark, sf_dir), known, P, limit=LIMIT)
    twins = ex.with_masked_twins(rows, toxic_words(spark, sf_dir), P, LIMIT)
    return _show(twins, "query_id", "rank", "form", "lemma", "score", "is_twin")


def forms_of_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.forms_of_lemma(lemma_lexicon(spark, sf_dir), P)


def paradigm_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.paradigm_forms(inflected_paradigms(base_lexicon(spark, sf_dir)))


def paradigm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested grid, one line per lemma and number."""
    grid = lx.paradigm_grid(inflected_paradigms(base_lexicon(spark, sf_dir)))
    return grid.select("lemma", F.posexplode("groups").alias("p", "g")).select(
        "lemma",
        F.col("p").cast("int").alias("place"),
        "g.number",
        F.array_join(
            F.transform("g.forms", lambda c: F.concat(c["case"], F.lit("="), c["form"])), " "
        ).alias("cells"),
    )


_SOURCES = "['exact','prefix','short_prefix','completion','ending','fuzzy1'][source_ord + 1]"


def _scored(extra: str = "") -> tuple[str, str]:
    return (
        "scored",
        f"SELECT q.query_id, s.form, s.lemma, s.freq, s.source_ord, {o.score()} AS score "
        f"FROM qs q JOIN sig s USING (norm_input) {extra}",
    )


_FLAT_TOP = (
    "SELECT query_id, r AS rank, form, lemma, round(score, 6) AS score, "
    f"{_SOURCES} AS source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {o.ORDER}) AS r "
    f"FROM scored) WHERE r <= {LIMIT}"
)
# Lemma of a word: the most frequent word it is an ending of, if any.
_LEMMAS = (
    "lemmas",
    "SELECT form, coalesce((SELECT s.form FROM (SELECT unnest(["
    + ", ".join(
        f"CASE WHEN ends_with(l.form, '{e}') THEN left(l.form, length(l.form) - {len(e)}) END"
        for e in P.endings
    )
    + "]) AS stem) k JOIN lex s ON s.form = k.stem ORDER BY s.freq DESC, s.form DESC LIMIT 1), l.form) AS lem FROM lex l",
)
_GROUPED = [
    _LEMMAS,
    (
        "best",
        "SELECT * FROM (SELECT s.* EXCLUDE (lemma), m.lem AS lemma, row_number() OVER (PARTITION BY query_id, m.lem "
        "ORDER BY score DESC, source_ord, freq DESC, s.form) AS b FROM scored s JOIN lemmas m ON m.form = s.form) WHERE b = 1",
    ),
    (
        "groups",
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {o.ORDER}) AS r FROM best) "
        f"WHERE r <= {GROUP_LIMIT}",
    ),
]
_RANK = [*o.lex(), *o.queries(), *o.static_signals()]
_CONTEXT_QUERIES = [
    (
        "cq",
        "SELECT DISTINCT coalesce(prev, '') AS prev, word FROM (SELECT item_id, p, "
        f"{o.norm('tok')} AS word, lag(regexp_replace({o.norm('tok')}, '^[^{P.letter_class}]+|[^{P.letter_class}]+$', '', 'g')) "
        "OVER (PARTITION BY item_id ORDER BY p) AS prev FROM (SELECT item_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS tok "
        f"FROM (SELECT item_id, regexp_extract_all(text, '{o.RUN}') AS ws FROM benchmark)))",
    ),
    (
        "qs",
        f"SELECT prev || ' ' || word AS query_id, prev, {o.shorthand('word')} AS norm_input, "
        f"{o.skel(o.shorthand('word'))} AS skel FROM cq",
    ),
    o.allowed_inputs("qs"),
]
_SHORTCUTS = (
    "shortcuts",
    f"SELECT {o.shorthand('form')} AS key, row_number() OVER (PARTITION BY {o.shorthand('form')} ORDER BY freq DESC, form) AS ord, "
    "upper(form) AS form, form AS lemma FROM lex WHERE freq >= 100",
)
_CELLS = ", ".join(
    f"('{number}', {i}, '{ending}')"
    for number, endings in (
        ("sing", ("", "s", "en", "ed", "ing", "er")),
        ("plur", ("es", "ers", "ens", "eds", "ings", "ent")),
    )
    for i, ending in enumerate(endings, start=1)
)
PARADIGMS = (
    "paradigms",
    f"SELECT l.form AS lemma, c.number, c.case_ord, l.form || c.ending AS form FROM lex l, (VALUES {_CELLS}) c(number, case_ord, ending)",
)

SQL = {
    "ranked_flat": o.with_(*_RANK, _scored()) + _FLAT_TOP,
    "ranked_grouped": o.with_(*_RANK, _scored(), *_GROUPED)
    + f"SELECT query_id, r AS rank, form, lemma, round(score, 6) AS score, {_SOURCES} AS source FROM groups",
    "group_variants": o.with_(*_RANK, _scored(), *_GROUPED)
    + "SELECT g.query_id, g.r AS rank, g.lemma, g.form, coalesce(string_agg(l.form, ' ' ORDER BY l.freq DESC, l.form), '') AS variants "
    "FROM groups g LEFT JOIN lemmas m ON m.lem = g.lemma AND m.form <> g.form LEFT JOIN lex l ON l.form = m.form GROUP BY ALL",
    "ranked_context": o.with_(
        *o.lex(),
        *_CONTEXT_QUERIES,
        *o.static_signals(),
        *corpus.LM_PARTS,
        (
            "scored",
            f"SELECT q.query_id, s.form, s.lemma, s.freq, s.source_ord, {o.score({'context': 'coalesce(m.pmi, 0.0::DOUBLE)'})} AS score "
            "FROM qs q JOIN sig s USING (norm_input) LEFT JOIN pmi m ON m.prev = q.prev AND m.word = s.form",
        ),
    )
    + _FLAT_TOP,
    "ranked_shortcuts": o.with_(
        *_RANK,
        _scored(),
        _SHORTCUTS,
        (
            "every",
            "SELECT query_id, 0 AS ord, form, lemma, freq, source_ord, score, 0 AS quick FROM scored UNION ALL "
            "SELECT q.query_id, c.ord, c.form, c.lemma, 0.0, 0, 1000.0, 1 FROM qs q JOIN shortcuts c ON c.key = q.norm_input",
        ),
        (
            "firsts",
            "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(form) ORDER BY quick DESC, ord, "
            f"{o.ORDER}) AS b FROM every) WHERE b = 1",
        ),
    )
    + "SELECT query_id, r AS rank, form, lemma, round(score, 6) AS score, "
    f"CASE WHEN quick = 1 THEN 'shortcut' ELSE {_SOURCES} END AS source FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY query_id ORDER BY quick DESC, ord, {o.ORDER}) AS r FROM firsts) WHERE r <= {LIMIT}",
    "ranked_masked": o.with_(
        *_RANK,
        _scored(),
        corpus.TOXIC,
        ("flat", _FLAT_TOP),
        (
            "twins",
            f"SELECT query_id, rank, score, form, lemma, 0 AS is_twin FROM flat UNION ALL "
            f"SELECT query_id, rank, score, {corpus.mask_sql('form')}, {corpus.mask_sql('form')}, 1 FROM flat "
            f"WHERE lemma IN (SELECT lemma FROM toxic) AND {corpus.mask_sql('form')} IS NOT NULL",
        ),
        (
            "kept",
            "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, form ORDER BY rank, is_twin) AS nth FROM twins) "
            "WHERE is_twin = 0 OR nth = 1",
        ),
    )
    + "SELECT query_id, r AS rank, form, lemma, score, is_twin FROM (SELECT * EXCLUDE (rank), row_number() OVER "
    f"(PARTITION BY query_id ORDER BY rank, is_twin) AS r FROM kept) WHERE r <= {LIMIT}",
    "forms_of_lemma": o.with_(*o.lex(), _LEMMAS)
    + "SELECT m.lem AS lemma, (row_number() OVER (PARTITION BY m.lem ORDER BY l.freq DESC, l.form))::INT AS ord, l.form "
    "FROM lemmas m JOIN lex l ON l.form = m.form",
    "paradigm_forms": o.with_(*o.lex(), PARADIGMS)
    + "SELECT lemma, (row_number() OVER (PARTITION BY lemma ORDER BY place))::INT AS ord, form FROM (SELECT lemma, form, "
    "min(CASE number WHEN 'sing' THEN 0 ELSE 100 END + case_ord) AS place FROM paradigms GROUP BY lemma, form)",
    "paradigm_grid": o.with_(*o.lex(), PARADIGMS)
    + "SELECT lemma, CASE number WHEN 'sing' THEN 0 ELSE 1 END AS place, number, string_agg("
    "['nomn','gent','datv','accs','ablt','loct'][case_ord] || '=' || form, ' ' ORDER BY case_ord) AS cells FROM paradigms GROUP BY ALL",
}
RUN = {name: globals()[name] for name in SQL}
