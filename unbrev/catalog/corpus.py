"""Registered queries over text: counting, n-grams, word keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import P, base_lexicon, table, toxic_words, word_counts
from unbrev.functions import text as tx
from unbrev.operators.lexicons import vocabulary
from unbrev.plans import corpus, lexicon
from unbrev.session import settle

BIGRAM_MIN = 3
BIGRAM_TOP = 1000
MINE_LEXICON_MIN = 10


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_counts(table(spark, sf_dir, "documents"), P, min_count=2)


def raw_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ``(form, lemma, freq)`` rows: each word as spelt, by language."""
    raw = table(spark, sf_dir, "documents").select(
        "lang", F.explode(F.regexp_extract_all("text", F.lit(o.WORD), F.lit(0))).alias("form")
    )
    rows = raw.groupBy("form", "lang").agg(F.count(F.lit(1)).cast("double").alias("freq"))
    return rows.withColumn("lemma", F.concat("form", F.lit("-"), "lang"))


def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = lexicon.build_lexicon(raw_frequencies(spark, sf_dir), P, 2.0)
    return built.select("form", "lemma", "freq")


def skeleton_best_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.best_word_per_skeleton(base_lexicon(spark, sf_dir), P)


def mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read for the lexicon, for its skeletons and for the tokens.
    counts = settle(word_counts(spark, sf_dir))
    known = lexicon.lexicon_from_counts(counts, MINE_LEXICON_MIN)
    return corpus.mine_pairs(counts, known, P)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.text_lines(table(spark, sf_dir, "documents"))
    return corpus.line_tokens(lines, P)


def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(base_lexicon(spark, sf_dir), P)
    return corpus.unigram_counts(_tokens(spark, sf_dir), vocab)


def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(base_lexicon(spark, sf_dir), P)
    return corpus.bigram_counts(_tokens(spark, sf_dir), vocab, BIGRAM_MIN)


def _ngrams(
    spark: SparkSession, sf_dir: str, top: int | None = None
) -> tuple[DataFrame, DataFrame]:
    lines = corpus.text_lines(table(spark, sf_dir, "documents"))
    return corpus.build_bigrams(lines, base_lexicon(spark, sf_dir), P, top, BIGRAM_MIN)


def bigram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngrams(spark, sf_dir, BIGRAM_TOP)[1]


def pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted pair; the counts are looked up several times, so they are settled."""
    return corpus.pmi_table(*map(settle, _ngrams(spark, sf_dir)))


def bigram_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pmi(spark, sf_dir).withColumn("pmi", F.round("pmi", 6))


def oov_breaks_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent pairs by whether each word is in the vocabulary."""
    known = vocabulary(base_lexicon(spark, sf_dir), P).select("norm", F.lit(True).alias("k"))
    pairs = corpus.adjacent_counts(_tokens(spark, sf_dir))
    prev = known.select(F.col("norm").alias("prev"), F.col("k").alias("pk"))
    word = known.select(F.col("norm").alias("word"), F.col("k").alias("wk"))
    return (
        pairs.join(prev, "prev", "left")
        .join(word, "word", "left")
        .groupBy(
            F.coalesce("pk", F.lit(False)).alias("prev_known"),
            F.coalesce("wk", F.lit(False)).alias("word_known"),
        )
        .agg(F.sum("cnt").alias("pairs"), F.count(F.lit(1)).alias("types"))
    )


def html_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = pages.select(tx.strip_tags(F.col("html")).alias("text"))
    return corpus.token_counts(text, P)


def word_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar key of every distinct word of the documents."""
    w = F.col("word")
    return word_counts(spark, sf_dir).select(
        "word",
        tx.skeleton(w, P).alias("skel"),
        tx.known_ending(w, P).alias("ending"),
        F.array_join(F.array_sort(tx.delete_variants(tx.skeleton(w, P))), " ").alias("deletes"),
        F.size(tx.prefixes(w, 3)).cast("bigint").alias("n_prefixes"),
        tx.mask_form(w).alias("masked"),
        tx.is_plain_word(w, P).alias("plain"),
        tx.title_case_name(w).alias("titled"),
    )


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the conversations with up to three words before it."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", F.explode(tx.tokens_with_context(F.col("text"), P)).alias("w")
    ).select(
        "conv_id",
        "turn",
        F.col("w.pos").cast("bigint").alias("pos"),
        F.col("w.token").alias("token"),
        F.array_join("w.context", " ").alias("context"),
        tx.last_context_key(F.col("w.context"), P).alias("prev_key"),
    )


def trailing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word each conversation turn ends with, and the words before it."""
    turns = table(spark, sf_dir, "conversations")
    # The caret stands before the closing punctuation.
    text = F.regexp_replace("text", r"[\s.]+$", "")
    token = tx.trailing_token(F.col("t"), P)
    before = F.expr("left(t, length(t) - length(token))")
    return (
        turns.select("conv_id", "turn", text.alias("t"))
        .withColumn("token", token)
        .select(
            "conv_id",
            "turn",
            "token",
            F.array_join(tx.previous_words(before, P, 2), " ").alias("context"),
        )
    )


def mask_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon words on the censor list with their masked spelling."""
    listed = toxic_words(spark, sf_dir)
    return base_lexicon(spark, sf_dir).join(listed, "lemma", "left_semi").select(
        "form", tx.mask_form(F.col("form")).alias("masked")
    )


_LINES = (
    "lines",
    f"SELECT row_number() OVER () AS line_no, line FROM "
    f"(SELECT unnest(string_split(text, chr(10))) AS line FROM documents)",
)
_TOK_LINES = (
    "toks",
    "SELECT line_no, list_filter(regexp_split_to_array("
    f"{o.norm('line')}, '[^{P.letter_class}-]+'), lambda t: t NOT IN ('', '-')) AS ws FROM lines",
)
_POS = (
    "pos",
    "SELECT line_no, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM toks",
)
_RAW_PAIRS = (
    "raw_pairs",
    "SELECT prev, word, count(*) AS cnt FROM (SELECT w AS word, "
    "lag(w) OVER (PARTITION BY line_no ORDER BY p) AS prev FROM pos) WHERE prev IS NOT NULL GROUP BY ALL",
)
_LINE_PARTS = [_LINES, _TOK_LINES, _POS, _RAW_PAIRS]
_BIGRAMS = (
    "bigrams",
    "SELECT prev, word, cnt FROM raw_pairs WHERE prev IN (SELECT form FROM lex) "
    f"AND word IN (SELECT form FROM lex) AND cnt >= {BIGRAM_MIN}",
)
_UNIGRAMS = (
    "unigrams",
    "SELECT w AS word, count(*) AS cnt FROM pos WHERE w IN (SELECT form FROM lex) GROUP BY w",
)
_PMI = (
    "pmi",
    "SELECT b.prev, b.word, least(4.0::DOUBLE, greatest(0.0::DOUBLE, ln("
    "b.cnt::DOUBLE * (SELECT sum(cnt) FROM unigrams)::DOUBLE / (p.cnt::DOUBLE * w.cnt::DOUBLE)))) AS pmi "
    "FROM bigrams b JOIN unigrams p ON p.word = b.prev JOIN unigrams w ON w.word = b.word",
)
LM_PARTS = [*_LINE_PARTS, _UNIGRAMS, _BIGRAMS, _PMI]
TOXIC = (
    "toxic",
    "SELECT word AS lemma FROM (SELECT toxic, "
    f"{o.norm('raw')} AS word FROM (SELECT l.toxic, unnest(regexp_extract_all(d.text, '{o.WORD}')) AS raw "
    "FROM documents d JOIN labels l USING (doc_id))) GROUP BY word HAVING min(toxic) = 1",
)


def mask_sql(x: str) -> str:
    """Masked spelling: a list of characters, the inside replaced in turn."""
    n = f"length(replace({x}, '-', ''))"
    head = f"greatest(1, ceil({n} / 3.0)::INT)"
    at = f"length(replace(left({x}, i - 1), '-', ''))"
    return (
        f"CASE WHEN {head} + 1 < {n} THEN array_to_string(list_transform(range(1, length({x}) + 1), "
        f"lambda i: CASE WHEN substr({x}, i, 1) <> '-' AND {at} >= {head} AND {at} < {n} - 1 "
        f"THEN substr('{tx.MASK_SYMBOLS}', ({at} - {head}) % 7 + 1, 1) ELSE substr({x}, i, 1) END), '') END"
    )


_CTX_WORDS = (
    "SELECT conv_id, turn, generate_subscripts(ws, 1) AS pos, unnest(ws) AS token, ws FROM "
    f"(SELECT conv_id, turn, regexp_extract_all(text, '{o.RUN}') AS ws FROM conversations)"
)

SQL = {
    "token_counts": o.with_(o.counts("c", "documents")) + "SELECT * FROM c WHERE cnt >= 2",
    "lexicon_build": (
        "SELECT form, lemma, freq FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY freq DESC, raw_lemma DESC) AS r "
        f"FROM (SELECT {o.norm('raw')} AS form, {o.norm('raw_lemma')} AS lemma, raw_lemma, freq FROM "
        "(SELECT raw, raw || '-' || lang AS raw_lemma, count(*)::DOUBLE AS freq FROM "
        f"(SELECT lang, unnest(regexp_extract_all(text, '{o.WORD}')) AS raw FROM documents) GROUP BY raw, lang) "
        "WHERE freq >= 2)) WHERE r = 1"
    ),
    "skeleton_best_word": o.with_(*o.lex())
    + "SELECT skel, form AS word, freq FROM (SELECT *, row_number() OVER (PARTITION BY skel ORDER BY freq DESC, form) AS r "
    "FROM lex WHERE skel <> '') WHERE r = 1",
    "mined_pairs": o.with_(
        *o.lex(MINE_LEXICON_MIN),
        (
            "best",
            "SELECT skel, form FROM (SELECT *, row_number() OVER (PARTITION BY skel ORDER BY freq DESC, form) AS r "
            "FROM lex WHERE skel <> '') WHERE r = 1",
        ),
        (
            "unknown",
            f"SELECT word, cnt, {o.skel('word')} AS skel FROM counts ANTI JOIN lex ON lex.form = counts.word "
            "WHERE cnt >= 2 AND length(word) >= 2",
        ),
    )
    + "SELECT u.word AS token, b.form AS word, u.cnt FROM unknown u JOIN best b ON b.skel = u.skel "
    "WHERE length(u.word) < length(b.form)",
    "unigram_counts": o.with_(*o.lex(), *_LINE_PARTS, _UNIGRAMS) + "SELECT word, cnt FROM unigrams",
    "bigram_counts": o.with_(*o.lex(), *_LINE_PARTS, _BIGRAMS) + "SELECT prev, word, cnt FROM bigrams",
    "bigram_top": o.with_(*o.lex(), *_LINE_PARTS, _BIGRAMS)
    + "SELECT b.prev, b.word, b.cnt FROM bigrams b JOIN lex p ON p.form = b.prev JOIN lex w ON w.form = b.word "
    f"ORDER BY b.cnt DESC, p.freq DESC, b.prev, w.freq DESC, b.word LIMIT {BIGRAM_TOP}",
    "bigram_pmi": o.with_(*o.lex(), *LM_PARTS) + "SELECT prev, word, round(pmi, 6) AS pmi FROM pmi",
    "oov_breaks_adjacency": o.with_(*o.lex(), *_LINE_PARTS)
    + "SELECT prev IN (SELECT form FROM lex) AS prev_known, word IN (SELECT form FROM lex) AS word_known, "
    "sum(cnt)::BIGINT AS pairs, count(*) AS types FROM raw_pairs GROUP BY ALL",
    "html_text_tokens": o.with_(
        ("pt", "SELECT regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages"),
        o.counts("c", "pt"),
    )
    + "SELECT * FROM c",
    "word_keys": o.with_(o.counts("c", "documents"))
    + f"SELECT word, {o.skel('word')} AS skel, {o.ending('word')} AS ending, "
    f"array_to_string(list_sort({o.deletes(o.skel('word'))}), ' ') AS deletes, "
    f"greatest(length(word) - 2, 0) AS n_prefixes, {mask_sql('word')} AS masked, true AS plain, "
    "array_to_string(list_transform(string_split(word, '-'), lambda s: upper(left(s, 1)) || substr(s, 2)), '-') AS titled FROM c",
    "context_windows": "SELECT conv_id, turn, pos, token, "
    "array_to_string(ws[greatest(pos - 3, 1):pos - 1], ' ') AS context, coalesce(list_last(list_filter(list_transform("
    f"ws[greatest(pos - 3, 1):pos - 1], lambda w: regexp_replace({o.norm('w')}, '^[^{P.letter_class}]+|[^{P.letter_class}]+$', '', 'g')), "
    f"lambda k: k <> '')), '') AS prev_key FROM ({_CTX_WORDS})",
    "trailing_tokens": "SELECT conv_id, turn, token, array_to_string(ws[greatest(len(ws) - 1, 1):len(ws)], ' ') AS context FROM ("
    f"SELECT conv_id, turn, token, regexp_extract_all(left(t, length(t) - length(token)), '{o.RUN}') AS ws FROM ("
    f"SELECT conv_id, turn, t, regexp_extract(t, '[{P.raw_letter_class}-]*$') AS token FROM ("
    "SELECT conv_id, turn, regexp_replace(text, '[\\s.]+$', '') AS t FROM conversations)))",
    "mask_forms": o.with_(*o.lex(), TOXIC)
    + f"SELECT form, {mask_sql('form')} AS masked FROM lex WHERE lemma IN (SELECT lemma FROM toxic)",
}
RUN = {name: globals()[name] for name in SQL}
