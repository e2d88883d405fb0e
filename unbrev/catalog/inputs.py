"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.functions import text as tx
from unbrev.operators.blocked import running_total
from unbrev.plans import corpus, lexicon
from unbrev.profile import LATIN
from unbrev.session import settle, tune
from unbrev.sources.tables import spread_small

P = LATIN
LEXICON_MIN_COUNT = 3


TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; text tables are spread over the cores if need be."""
    rows = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(rows) if name in TEXT_TABLES else rows


def word_counts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return corpus.token_counts(table(spark, sf_dir, name), P)


def base_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents seen at least three times, each its own lemma.

    Settled: every use of it would count the words of all documents again.
    """
    return settle(lexicon.lexicon_from_counts(word_counts(spark, sf_dir), LEXICON_MIN_COUNT))


def shorthand(word: Column) -> Column:
    """First letter, the skeleton of the rest, and a known ending kept whole."""
    ending = tx.known_ending(word, P)
    long_enough = F.length(word) > F.length(ending) + 1
    kept = F.coalesce(F.when(long_enough, ending), F.lit(""))
    middle = F.substring(word, F.lit(2), F.length(word) - 1 - F.length(kept))
    return F.concat(F.left(word, F.lit(1)), tx.skeleton(middle, P), kept)


def shorthand_queries(
    spark: SparkSession, sf_dir: str, name: str = "benchmark"
) -> DataFrame:
    """One query per distinct word of a text table, typed as its shorthand."""
    words = word_counts(spark, sf_dir, name)
    return words.select(F.col("word").alias("query_id"), shorthand(F.col("word")).alias("input"))


def stem_table(lex: DataFrame) -> DataFrame:
    """A small morphology table: words that are another word plus an ending.

    Rows ``form, lemma, tags, score``; the score is the stem's frequency.
    """
    ended = lex.select(
        "form", F.explode(tx.known_endings(F.col("form"), P)).alias("ending")
    ).select(
        "form",
        "ending",
        F.expr("left(form, length(form) - length(ending))").alias("lemma"),
    )
    stems = lex.select(F.col("form").alias("lemma"), F.col("freq").alias("score"))
    return ended.join(stems, "lemma").select(
        "form", "lemma", F.concat(F.lit("end,"), "ending").alias("tags"), "score"
    )


def lemma_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = base_lexicon(spark, sf_dir)
    return settle(lexicon.lemmatize_lexicon(lex, stem_table(lex), P))


# Endings that stand in for an inflection table.
SING_ENDINGS = ("", "s", "en", "ed", "ing", "er")
PLUR_ENDINGS = ("es", "ers", "ens", "eds", "ings", "ent")


def inflected_paradigms(lex: DataFrame) -> DataFrame:
    """Long paradigm table of every lexicon word, from the ending lists."""
    cells = F.array(
        *[
            F.struct(
                F.lit(number).alias("number"),
                F.lit(i).alias("case_ord"),
                F.lit(ending).alias("ending"),
            )
            for number, endings in (("sing", SING_ENDINGS), ("plur", PLUR_ENDINGS))
            for i, ending in enumerate(endings, start=1)
        ]
    )
    return lex.select(F.col("form").alias("lemma"), F.explode(cells).alias("c")).select(
        "lemma",
        "c.number",
        F.lit(None).cast("string").alias("gender"),
        "c.case_ord",
        F.concat("lemma", "c.ending").alias("form"),
    )


def toxic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents labelled toxic that no other labelled document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labelled = docs.join(labels, "doc_id").select(
        "toxic", F.explode(tx.word_tokens(F.col("text"), P)).alias("lemma")
    )
    return (
        labelled.groupBy("lemma").agg(F.min("toxic").alias("t")).filter("t = 1").select("lemma")
    )


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word stream ``(session_id, pos, word)`` of the conversations, numbered
    without gaps: words of earlier turns first, then the place in the turn."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        "turn",
        tx.words_in(F.col("text"), P).alias("words"),
    )
    counted = turns.withColumn("n", F.size("words").cast("bigint"))
    ended = running_total(
        counted, ["session_id"], [F.floor(F.col("turn") / 4096)], [F.col("turn")], F.col("n"), "end"
    )
    words = ended.select(
        "session_id",
        (F.col("end") - F.col("n")).alias("before"),
        F.posexplode("words").alias("p", "word"),
    )
    # The session jobs read the stream several times.
    return settle(
        words.select("session_id", (F.col("before") + F.col("p") + 1).alias("pos"), "word")
    )


def pick_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an editing session: clicks pick, errors undo, the rest types."""
    kind = (
        F.when(F.col("event_type") == "click", "pick")
        .when(F.col("event_type") == "error", "undo")
        .otherwise("type")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        kind.alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def hour(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3_600_000_000)
