"""Registered queries over acceptance events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import oracle as o
from unbrev.catalog.inputs import P, base_lexicon, hour, pick_events, shorthand_queries, table
from unbrev.catalog.ranking import FLAT, LIMIT, _show
from unbrev.plans import expand as ex
from unbrev.plans import history as hi
from unbrev.settings import Settings


def pending_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = hi.resolve_picks(pick_events(spark, sf_dir), "user_id", ["ts", "event_id"], hour())
    return picks.select("event_id", "user_id", "status")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(table(spark, sf_dir, "events"))


def log_rows(events: DataFrame) -> DataFrame:
    """Log rows of the events: clicks confirm and errors revert a form named by
    the event's key."""
    events = events.filter(F.col("event_type").isin("click", "error"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "click", "confirmed").otherwise("reverted").alias("status"),
        F.concat(F.lit("Wrd"), (k % 7).cast("string")).alias("shorthand"),
        F.concat(F.lit("Word"), (k % 10).cast("string")).alias("form"),
    )


def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.history_from_log(log(spark, sf_dir), P)


def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two devices: odd and even users' logs under one account per ten users."""
    counted = history_counts(spark, sf_dir).withColumn("n", F.col("user_id").cast("bigint"))
    account = (F.col("n") % 10).cast("string")
    device = [
        counted.filter(F.col("n") % 2 == half).withColumn("user_id", account).drop("n")
        for half in (0, 1)
    ]
    return hi.merge_histories(*device)


def history_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors = hi.history_priors(history_counts(spark, sf_dir))
    return priors.withColumn("prior", F.round("prior", 6))


def form_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hi.form_popularity(history_counts(spark, sf_dir))


def acceptance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hi.acceptance_quality(log(spark, sf_dir))
    return rows.withColumns(
        {c: F.round(c, 6) for c in ("accept_quality", "rejection_rate")}
    )


def earned_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hi.earned_exceptions(log(spark, sf_dir), ("user_id", "shorthand", "form"))
    return rows.withColumn("rejection_rate", F.round("rejection_rate", 6))


def ranked_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking for a user who confirmed each fifth-ranked form three times and
    reverted each first-ranked form once."""
    lex = base_lexicon(spark, sf_dir)
    queries = shorthand_queries(spark, sf_dir).withColumn("user_id", F.lit("u"))
    first = ex.expand_tokens(queries, ex.Knowledge(lex), P, Settings(), LIMIT)
    known = ex.prepare_queries(queries, P).select("query_id", "input_skel")
    history = (
        first.filter(F.col("rank").isin(1, 5))
        .join(known, "query_id")
        .groupBy(F.lit("u").alias("user_id"), F.col("input_skel").alias("skeleton"), "form")
        .agg(
            F.sum(F.when(F.col("rank") == 5, 3).otherwise(0)).alias("confirmed"),
            F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("reverted"),
        )
    )
    return _show(
        ex.expand_tokens(queries, ex.Knowledge(lex, history=history), P, limit=LIMIT), *FLAT
    )


_LOG = (
    "log",
    "SELECT ts, user_id::VARCHAR AS user_id, CASE event_type WHEN 'click' THEN 'confirmed' ELSE 'reverted' END AS status, "
    "'Wrd' || (k % 7) AS shorthand, 'Word' || (k % 10) AS form FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k "
    "FROM events) WHERE event_type IN ('click', 'error')",
)
_HIST = (
    "hist",
    f"SELECT user_id, {o.skel('lower(shorthand)')} AS skeleton, lower(form) AS form, count(*) FILTER (status = 'confirmed') AS confirmed, "
    "count(*) FILTER (status = 'reverted') AS reverted FROM log GROUP BY ALL",
)
_POP = (
    "pop",
    "SELECT user_id, form, sum(confirmed)::BIGINT AS form_count FROM hist GROUP BY ALL HAVING sum(confirmed) > 0",
)
_RANK = [*o.lex(), *o.queries(), *o.static_signals()]
_SOURCES = "['exact','prefix','short_prefix','completion','ending','fuzzy1'][source_ord + 1]"

SQL = {
    "pending_confirm": "SELECT event_id, user_id, CASE WHEN nxt = 'error' THEN 'reverted' ELSE 'confirmed' END AS status FROM ("
    "SELECT event_id, user_id::VARCHAR AS user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt "
    "FROM events) WHERE event_type = 'click'",
    "history_counts": o.with_(_LOG, _HIST) + "SELECT * FROM hist",
    "history_merge": o.with_(_LOG, _HIST)
    + "SELECT (user_id::BIGINT % 10)::VARCHAR AS user_id, skeleton, form, sum(confirmed)::BIGINT AS confirmed, sum(reverted)::BIGINT AS reverted "
    "FROM hist GROUP BY ALL",
    "history_prior": o.with_(_LOG, _HIST, _POP)
    + "SELECT h.user_id, h.skeleton, h.form, round(2.0::DOUBLE * (ln(1.0::DOUBLE + confirmed) - ln(1.0::DOUBLE + reverted)) "
    "+ 0.5::DOUBLE * ln(1.0::DOUBLE + coalesce(form_count, 0)), 6) AS prior FROM hist h LEFT JOIN pop p ON p.user_id = h.user_id AND p.form = h.form",
    "form_popularity": o.with_(_LOG, _HIST, _POP) + "SELECT * FROM pop",
    "acceptance_quality": o.with_(_LOG)
    + "SELECT shorthand, form, count(*) AS tapped, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'reverted') "
    "AS reverted, round((count(*) FILTER (status = 'confirmed'))::DOUBLE / count(*), 6) AS accept_quality, "
    "round((count(*) FILTER (status = 'reverted'))::DOUBLE / count(*), 6) AS rejection_rate FROM log GROUP BY shorthand, form",
    "earned_exceptions": o.with_(
        _LOG,
        (
            "rev",
            "SELECT user_id, shorthand, form, count(*) OVER (PARTITION BY user_id, shorthand, form ORDER BY ts "
            "RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n FROM log WHERE status = 'reverted'",
        ),
        ("burst", "SELECT user_id, shorthand, form, max(n) AS most FROM rev GROUP BY ALL"),
        (
            "q",
            "SELECT user_id, shorthand, form, count(*) AS tapped, count(*) FILTER (status = 'reverted') AS reverted FROM log GROUP BY ALL",
        ),
    )
    + "SELECT q.user_id, q.shorthand, q.form, tapped, reverted, round(reverted::DOUBLE / tapped, 6) AS rejection_rate, "
    "coalesce(most, 0) AS most_reverts FROM q LEFT JOIN burst b ON b.user_id = q.user_id AND b.shorthand = q.shorthand AND b.form = q.form "
    "WHERE (tapped >= 5 AND reverted::DOUBLE / tapped > 0.5) OR coalesce(most, 0) >= 3",
    "ranked_history": o.with_(
        *_RANK,
        (
            "cold",
            f"SELECT q.query_id, s.input_skel, s.form, s.lemma, s.freq, s.source_ord, {o.score()} AS score FROM qs q JOIN sig s USING (norm_input)",
        ),
        (
            "firsts",
            f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {o.ORDER}) AS r FROM cold) WHERE r IN (1, 5)",
        ),
        (
            "hist",
            "SELECT input_skel AS skeleton, form, sum(CASE r WHEN 5 THEN 3 ELSE 0 END) AS confirmed, sum(CASE r WHEN 1 THEN 1 ELSE 0 END) AS reverted "
            "FROM firsts GROUP BY ALL",
        ),
        ("pop", "SELECT form, sum(confirmed) AS form_count FROM hist GROUP BY form"),
        (
            "scored",
            "SELECT query_id, form, lemma, freq, source_ord, " + o.score({"user": "s_user"}) + " AS score FROM ("
            "SELECT q.query_id, s.*, 2.0::DOUBLE * (ln(1.0::DOUBLE + coalesce(h.confirmed, 0)) - ln(1.0::DOUBLE + coalesce(h.reverted, 0))) "
            "+ 0.5::DOUBLE * ln(1.0::DOUBLE + coalesce(p.form_count, 0)) AS s_user FROM qs q JOIN sig s USING (norm_input) "
            "LEFT JOIN hist h ON h.skeleton = s.input_skel AND h.form = s.form LEFT JOIN pop p ON p.form = s.form)",
        ),
    )
    + f"SELECT query_id, r AS rank, form, lemma, round(score, 6) AS score, {_SOURCES} AS source FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY query_id ORDER BY {o.ORDER}) AS r FROM scored) WHERE r <= {LIMIT}",
}
RUN = {name: globals()[name] for name in SQL}
