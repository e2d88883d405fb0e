"""The registered queries of the operators, and their SQL where it can say the same.

Each query applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from unbrev.llm import (
    byte_bpe,
    context_mixing,
    language,
    lattice,
    mixing,
    near_text,
    ngram_ratio,
    phrases,
    ranked_search,
    repeats,
    secrets,
    url_filter,
    warc,
)
from unbrev.llm.common import crc_remainder, table

# -- 1: near-duplicate vectors ----------------------------------------------------


def op1_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of all vectors."""
    return lattice.near_vectors(table(spark, folder, "embeddings"))


# -- 2: language-model scores -----------------------------------------------------


def op2_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Base and model score of every document, learnt from those not held out."""
    docs = table(spark, folder, "documents")
    return context_mixing.score_texts(docs, crc_remainder(F.col("doc_id"), 5) == 1)


# -- 3: quality rules -----------------------------------------------------------


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's counts and verdict; documents labelled good are the target."""
    labels = table(spark, folder, "labels")
    trusted = labels.filter("quality = 1 and toxic = 0").select("doc_id")
    return ngram_ratio.judge_quality(table(spark, folder, "documents"), trusted)


# -- 4: byte-level BPE --------------------------------------------------------

BPE_PATTERN = public_tokenizers.PATTERN
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of every document, encoded and decoded."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, BPE_RANKS, BPE_PATTERN)


# -- 5: URL filters ---------------------------------------------------------

#: Rules (host, path, verdict) of the query.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Host labels whose pages make the query's list of URLs.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page url.

    The list holds the canonical URLs of pages on hosts with a label of
    ``LISTED_LABELS``, so it grows with the pages.
    """
    pages = table(spark, folder, "pages")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    names = "|".join(LISTED_LABELS)
    listed = pages.filter(host.rlike(rf"(^|\.)({names})(\.|$)")).select(
        url_filter.canonical(host, path).alias("url_key")
    )
    return url_filter.judge_urls(pages, listed, URL_RULES)


_URL_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), keyed AS (
  SELECT *, regexp_replace(host, '^www\\.', '')
    || regexp_replace(regexp_replace(path, '\\.html$', ''), '/+$', '') AS url_key,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/')
        THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/')
        THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM split
), list AS (
  SELECT DISTINCT url_key FROM keyed
  WHERE regexp_matches(host, '(^|\\.)(LABELS)(\\.|$)')
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list.url_key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  list.url_key IS NOT NULL AS listed
FROM keyed LEFT JOIN list ON keyed.url_key = list.url_key
""".replace("LABELS", "|".join(LISTED_LABELS))

# -- 10: WARC ---------------------------------------------------------------


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page through an archive, normalised, and back by the sidecar index."""
    archives, _ = warc.archive_pages(table(spark, folder, "pages"))
    back = warc.read_members(archives)
    return back.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


# -- 6: repeated strings --------------------------------------------------------


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What goes of every document because earlier documents have it."""
    return repeats.removal_report(table(spark, folder, "documents"))


# -- 7: near-duplicate texts --------------------------------------------------


def op7_near_text(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate documents on four-word shingles."""
    return near_text.near_duplicates(table(spark, folder, "documents"), words=4)


# -- 8: language identification -----------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from those not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(language.training_rows(docs, held_out), PIECES)
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


# -- 9: mixing ------------------------------------------------------------------


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's cell, weight, probability and fate."""
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        "kept",
    )


# -- 11: ranked search ------------------------------------------------------------


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    f"'[^{ranked_search.NO_TERM}]+')"
)
_SEARCH_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS_SQL} AS ts FROM documents WHERE text IS NOT NULL
), sizes AS (
  SELECT rid, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0
), total AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL
), postings AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
), scored AS (
  SELECT item_id, rid, sum(times * w * ((1000000000 * tf) //
    (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (rid), total GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored JOIN sizes USING (rid) WHERE score > 0
) WHERE rank <= {ranked_search.TOP}
"""

# -- 12: secrets ------------------------------------------------------------------


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets of every document."""
    return secrets.secret_report(table(spark, folder, "documents"))


# The engine's own letter folding knows more letters than A-Z, so both cases are spelt out.
_ASSIGN_SQL = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_SECRET_PATTERNS = [_ASSIGN_SQL, *[pattern for _, pattern, _ in secrets.BASE[1:]], secrets.CANDIDATE]
_SECRETS_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  {" UNION ALL ".join(
      f"SELECT rid, {i} AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs "
      f"FROM d WHERE regexp_matches(t, '{p}')" for i, p in enumerate(_SECRET_PATTERNS))}
), placed AS (
  SELECT rid, kind, ms[i] AS word, (list_sum(list_transform(ms[1:i], lambda x: length(x)))
    + list_sum(list_transform(gs[1:i], lambda x: length(x))))::BIGINT AS stop
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)
), base AS (
  SELECT rid, kind, stop - length(word) AS start, stop FROM placed
  WHERE (kind = 0 AND length(regexp_extract(word, '{_ASSIGN_SQL}', 2)) >= {secrets.BASE[0][2]})
    OR (kind = 1 AND length(word) >= {secrets.BASE[1][2]})
    OR (kind = 2 AND length(word) >= {secrets.BASE[2][2]})
), suspects AS (
  SELECT rid, stop - length(word) AS place, word, CASE {" ".join(
      f"WHEN regexp_full_match(word, '{p}') THEN {secrets.largest_sum(bits)}" for p, bits in secrets.CLASSES)} END AS most
  FROM placed WHERE kind = 3 AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[A-Za-z]')
    AND NOT ({" OR ".join(f"regexp_matches(word, '{p}')" for p in secrets.ALLOWED)})
), windows AS (
  SELECT rid, place, most, s, substr(word, s + 1, {secrets.WINDOW}) AS w
  FROM (SELECT *, unnest(range(0, length(word) - {secrets.WINDOW} + 1)) AS s FROM suspects)
), letters AS (
  SELECT rid, place, most, s, c, count(*) AS n
  FROM (SELECT rid, place, most, s, unnest(string_split(w, '')) AS c FROM windows) GROUP BY ALL
), hot AS (
  SELECT rid, place, s FROM letters GROUP BY rid, place, most, s
  HAVING sum(round(n * log2(n) * {secrets.SCALE})::BIGINT) <= most
), starts AS (
  SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY rid, place ORDER BY s) + {secrets.WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot
), islands AS (
  SELECT rid, place, s, sum(fresh) OVER (PARTITION BY rid, place ORDER BY s) AS island FROM starts
), added AS (
  SELECT rid, 3 AS kind, place + min(s) AS start, place + max(s) + {secrets.WINDOW} AS stop FROM islands GROUP BY rid, place, island
), more AS (
  SELECT * FROM added a WHERE NOT EXISTS
    (FROM base b WHERE b.rid = a.rid AND b.start <= a.start AND a.stop <= b.stop)
), named AS (
  SELECT *, {list(secrets.KINDS)}[kind + 1] || ':' || start || ':' || stop AS word FROM (FROM base UNION ALL FROM more)
), per_row AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
    string_agg(word, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(word, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN per_row USING (rid)
"""

# -- 13: phrases --------------------------------------------------------------------


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2 000 collocations of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


_PHRASES_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), starts AS (
  SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest(range(1, {phrases.LONGEST + 1})) AS k FROM words)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= {phrases.LEAST_COUNT}
), cuts AS (
  SELECT *, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT x.lang, x.phrase, x.k, x.a, x.c, p.f AS l, q.f AS r, n,
    ((1000::HUGEINT * x.a * n) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts x JOIN counts p ON p.lang = x.lang AND p.phrase = x.head
    JOIN counts q ON q.lang = x.lang AND q.phrase = x.tail JOIN totals t ON t.lang = x.lang
), worst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM scored) WHERE nth = 1
), kept AS (
  SELECT * FROM worst s WHERE NOT EXISTS (FROM candidates b WHERE b.lang = s.lang AND b.k > s.k
    AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) WHERE rank <= {phrases.TOP}
"""

RUN = {
    "op1_lattice": op1_lattice,
    "op2_context_mixing": op2_context_mixing,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op6_repeats": op6_repeats,
    "op7_near_text": op7_near_text,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op5_url_filter": op5_url_filter,
    "op10_warc": op10_warc,
    "op11_ranked_search": op11_ranked_search,
    "op12_secrets": op12_secrets,
    "op13_phrases": op13_phrases,
}

SQL = {
    "op5_url_filter": _URL_SQL,
    "op11_ranked_search": _SEARCH_SQL,
    "op12_secrets": _SECRETS_SQL,
    "op13_phrases": _PHRASES_SQL,
}


def queries() -> dict:
    return dict(RUN)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
