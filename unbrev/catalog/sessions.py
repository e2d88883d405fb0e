"""Registered queries over word streams and event sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import P, base_lexicon, conversation_words, hour, shorthand, table
from unbrev.catalog.ranking import FLAT, LIMIT, _show
from unbrev.plans import expand as ex
from unbrev.plans import sessions as se
from unbrev.session import settle

# Words of the test texts that stand for polite and crude ones.
MARKERS = (
    ("the", 1.0), ("and", 0.5), ("of", -1.0), ("in", -0.7), ("le", 1.0),
    ("la", -0.6), ("der", 0.8), ("die", -1.0), ("el", 0.4), ("que", -0.9),
)


def markers(spark: SparkSession) -> DataFrame:
    # One row exploded: the planner knows that it is small, which it does not of local rows.
    rows = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(s).alias("sign")) for w, s in MARKERS])
    return spark.range(1).select(F.explode(rows).alias("m")).select("m.word", "m.sign")


def _ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.session_ticks(conversation_words(spark, sf_dir), P)


def session_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticked(spark, sf_dir).select("session_id", "pos", "norm", "is_plain", "tick")


def session_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = se.last_seen_before(_ticked(spark, sf_dir))
    return seen.select(
        "session_id", "pos", "norm", "tick", "last_tick", F.round("recency", 6).alias("recency")
    )


def recency_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a session, looked up at the end of every stretch of 50 words
    that uses it."""
    ticked = _ticked(spark, sf_dir)
    probes = (
        ticked.filter("is_plain")
        .withColumn("at", F.floor(F.col("tick") / 50) * 50 + 50)
        .select("session_id", "norm", F.col("at").cast("bigint").alias("tick"))
        .distinct()
    )
    return se.last_seen_as_of(ticked, probes).select(
        "session_id", "norm", "tick", "last_tick", F.round("recency", 6).alias("recency")
    )


def session_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = se.tone_track(conversation_words(spark, sf_dir), markers(spark), P)
    return track.select(
        "session_id",
        "pos",
        F.round("tone_score", 6).alias("tone_score"),
        F.round("tone_mass", 6).alias("tone_mass"),
        "register",
    )


def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = se.session_features(conversation_words(spark, sf_dir), markers(spark), P)
    return rows.select(
        "session_id",
        "pos",
        "norm",
        "tick",
        F.round(F.coalesce("recency", F.lit(0.0)), 6).alias("recency"),
        "register",
    )


def session_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    numbered = se.number_sessions(events, "user_id", ["ts", "event_id"], "event_type", hour())
    return numbered.select("event_id", "user_id", "session_no")


def ranked_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking within conversations: every word of every conversation, typed as shorthand
    where it stands last, against the words before it and a lexicon of the documents;
    recent and unknown words of the session take part."""
    ticked = settle(_ticked(spark, sf_dir))
    asked = ticked.filter("is_plain").groupBy("session_id", "norm").agg((F.max("tick") - 1).alias("tick"))
    queries = asked.select(
        F.concat_ws(" ", "session_id", "norm").alias("query_id"),
        shorthand(F.col("norm")).alias("input"),
        "session_id",
        "tick",
    )
    known = ex.Knowledge(base_lexicon(spark, sf_dir), session_words=ticked)
    return _show(ex.expand_tokens(queries, known, P, limit=LIMIT), *FLAT)


_WORDS = [
    (
        "cw",
        "SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) AS pos, word FROM ("
        "SELECT conv_id, turn, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM "
        f"(SELECT conv_id, turn, regexp_extract_all(text, '{o.RUN}') AS ws FROM conversations))",
    ),
    (
        "cn",
        f"SELECT session_id, pos, {o.norm('word')} AS norm, regexp_matches({o.norm('word')}, '{o.PLAIN}') AS is_plain FROM cw",
    ),
    (
        "ct",
        "SELECT *, sum(is_plain::INT) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS tick FROM cn",
    ),
]
_MARKS = (
    "marks",
    "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {s}::DOUBLE)" for w, s in MARKERS) + ") m(word, sign)",
)
# Every word paired with the markers of the 600 words before it.
_TONE = (
    "tone",
    "SELECT c.session_id, c.pos, coalesce(sum(h.sign * pow(0.5::DOUBLE, (c.pos - h.pos) / 12.0::DOUBLE)), 0.0) AS tone_score, "
    "coalesce(sum(pow(0.5::DOUBLE, (c.pos - h.pos) / 12.0::DOUBLE)), 0.0) AS tone_mass FROM cn c LEFT JOIN "
    "(SELECT n.session_id, n.pos, m.sign FROM cn n JOIN marks m ON m.word = n.norm) h "
    "ON h.session_id = c.session_id AND h.pos BETWEEN c.pos - 600 AND c.pos GROUP BY ALL",
)
_REGISTER = (
    "CASE WHEN round(tone_mass, 9) < 0.5 THEN 'neutral' WHEN round(tone_score / tone_mass, 9) > 0.25 THEN 'polite' "
    "WHEN round(tone_score / tone_mass, 9) < -0.25 THEN 'crude' ELSE 'neutral' END"
)
# What letters and consonants that one word has more of cost at least.
_LETTERS = "length(form) - length(norm_input)"
_CONSONANTS = f"length({o.skel('form')}) - length({o.skel('norm_input')})"
_LEAST_COST = (
    f"greatest(22 * -({_LETTERS}), 5 * ({_LETTERS}), 10 * abs({_CONSONANTS}), "
    f"10 * ({_CONSONANTS}) + 5 * (({_LETTERS}) - ({_CONSONANTS})))"
)
_SEEN = (
    "seen",
    "SELECT *, lag(tick) OVER (PARTITION BY session_id, norm ORDER BY tick) AS last_tick FROM ct WHERE is_plain",
)

SQL = {
    "session_ticks": o.with_(*_WORDS) + "SELECT session_id, pos, norm, is_plain, tick FROM ct",
    "session_recency": o.with_(*_WORDS, _SEEN)
    + "SELECT session_id, pos, norm, tick, last_tick, round(coalesce(pow(0.5::DOUBLE, (tick - 1 - last_tick) / 80.0::DOUBLE), 0.0), 6) "
    "AS recency FROM seen",
    "recency_as_of": o.with_(
        *_WORDS,
        ("pr", "SELECT DISTINCT session_id, norm, (tick // 50) * 50 + 50 AS tick FROM ct WHERE is_plain"),
        ("us", "SELECT session_id, norm, tick FROM ct WHERE is_plain"),
    )
    + "SELECT p.session_id, p.norm, p.tick, u.tick AS last_tick, round(pow(0.5::DOUBLE, (p.tick - u.tick) / 80.0::DOUBLE), 6) AS recency "
    "FROM pr p ASOF JOIN us u ON u.session_id = p.session_id AND u.norm = p.norm AND u.tick <= p.tick",
    "session_tone": o.with_(*_WORDS, _MARKS, _TONE)
    + f"SELECT session_id, pos, round(tone_score, 6) AS tone_score, round(tone_mass, 6) AS tone_mass, {_REGISTER} AS register FROM tone",
    "session_features": o.with_(*_WORDS, _MARKS, _TONE, _SEEN)
    + "SELECT c.session_id, c.pos, c.norm, c.tick, round(coalesce(pow(0.5::DOUBLE, (s.tick - 1 - s.last_tick) / 80.0::DOUBLE), 0.0), 6) "
    f"AS recency, {_REGISTER} AS register FROM ct c JOIN tone t USING (session_id, pos) LEFT JOIN seen s USING (session_id, pos)",
    "session_numbering": "SELECT event_id, user_id, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM ("
    "SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS step "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
}
# Too slow for whole tables, since it works out every distance cell by cell; tests hold
# the query against it on a small table.
SESSION_SQL = (
    o.with_(
        *o.lex(),
        *_WORDS,
        (
            "qs",
            f"SELECT session_id || ' ' || norm AS query_id, {o.shorthand('norm')} AS norm_input, "
            f"{o.skel(o.shorthand('norm'))} AS skel, session_id, max(tick) - 1 AS asked FROM ct WHERE is_plain GROUP BY session_id, norm",
        ),
        o.allowed_inputs("qs"),
        *o.candidates(),
        ("uses", "SELECT t.session_id, t.norm, t.tick, w.word FROM ct t JOIN cw w USING (session_id, pos) WHERE is_plain"),
        # Words of a session that the lexicon lacks, with each use's time until the next.
        (
            "unknown_uses",
            f"SELECT *, lead(tick) OVER (PARTITION BY session_id, norm ORDER BY tick) AS nxt, {o.skel('norm')} AS skel "
            "FROM uses WHERE norm NOT IN (SELECT form FROM lex)",
        ),
        (
            "unknown",
            "SELECT q.query_id, q.norm_input, q.skel AS input_skel, u.norm, u.word AS display, q.asked - u.tick AS age "
            "FROM qs q JOIN inp USING (norm_input) JOIN unknown_uses u ON u.session_id = q.session_id "
            "AND left(u.skel, 1) = left(q.skel, 1) AND u.skel <> '' AND u.tick <= q.asked AND (u.nxt IS NULL OR u.nxt > q.asked) "
            f"WHERE q.skel <> '' AND q.asked - u.tick < {ex.MEMORY_TICKS}",
        ),
        (
            "all_pairs",
            "SELECT norm_input, form FROM (SELECT norm_input, form FROM cand UNION SELECT norm_input, norm FROM unknown) "
            f"WHERE {_LEAST_COST} <= {o.S.cutoff_base} + {o.S.cutoff_per_char} * length(norm_input)",
        ),
        *o.distances("all_pairs"),
        (
            "rows",
            "SELECT q.query_id, q.norm_input, i.skel AS input_skel, c.form AS norm, l.skel AS form_skel, c.form, l.lemma, l.freq, c.source_ord, "
            "coalesce(pow(0.5::DOUBLE, (q.asked - u.tick) / 80.0::DOUBLE), 0.0::DOUBLE) AS s_recency, 0 AS is_oov "
            "FROM qs q JOIN cand c USING (norm_input) JOIN inp i USING (norm_input) JOIN lex l ON l.form = c.form "
            "ASOF LEFT JOIN uses u ON u.session_id = q.session_id AND u.norm = c.form AND u.tick <= q.asked UNION ALL "
            f"SELECT query_id, norm_input, input_skel, norm, {o.skel('norm')}, display, display, 0.0, 0, "
            "pow(0.5::DOUBLE, age / 80.0::DOUBLE), 1 FROM unknown",
        ),
        (
            "scored",
            "SELECT *, " + o.score({"recency": "s_recency"}) + " AS score FROM (SELECT r.*, "
            "CASE WHEN input_skel = form_skel THEN 1.0::DOUBLE WHEN input_skel = '' THEN 0.0::DOUBLE "
            f"ELSE {o.common_prefix('input_skel', 'form_skel')}::DOUBLE / length(input_skel) END AS s_skeleton, "
            f"({o.common_ending('norm_input', 'norm')})::DOUBLE / 3.0::DOUBLE AS s_suffix, "
            f"{o.common_prefix('norm_input', 'norm')}::DOUBLE / length(norm_input) AS s_prefix, "
            "t.d::DOUBLE / 20.0::DOUBLE AS s_edit, ln(1.0::DOUBLE + greatest(freq, 0.0::DOUBLE)) AS s_freq "
            "FROM rows r JOIN dist t ON t.a = r.norm_input AND t.b = r.norm "
            f"WHERE t.d <= {o.S.cutoff_base} + {o.S.cutoff_per_char} * length(r.norm_input))",
        ),
        (
            "firsts",
            "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, norm ORDER BY score DESC, is_oov, source_ord, freq DESC, form) AS b "
            "FROM scored) WHERE b = 1",
        ),
    )
    + "SELECT query_id, r AS rank, form, lemma, round(score, 6) AS score, CASE WHEN is_oov = 1 THEN 'session' ELSE "
    "['exact','prefix','short_prefix','completion','ending','fuzzy1'][source_ord + 1] END AS source FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY score DESC, is_oov, source_ord, freq DESC, form) AS r FROM firsts) WHERE r <= 5"
)
RUN = {name: globals()[name] for name in SQL} | {"ranked_session": ranked_session}
