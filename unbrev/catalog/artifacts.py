"""Registered queries that write an artifact as sorted text and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.catalog import corpus as c
from unbrev.catalog import history as h
from unbrev.catalog import oracle as o
from unbrev.catalog import ranking as r
from unbrev.catalog.inputs import P, base_lexicon, word_counts
from unbrev.operators.lexicons import in_load_order
from unbrev.session import settle, shared_folder
from unbrev.sources import readers, writers


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/artifact-{uuid.uuid4().hex}"


def artifact_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written lexicon, numbered by the order of its lines over all part files."""
    path = _path(spark)
    writers.write_lexicon(base_lexicon(spark, sf_dir), path)
    return in_load_order(readers.read_lexicon(spark, path)).select("form_id", "form", "lemma", "freq")


def artifact_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    writers.write_ngrams(*map(settle, c._ngrams(spark, sf_dir)), path)
    one, two = readers.read_ngrams(spark, path, P)
    return one.select(F.lit("").alias("prev"), "word", "cnt").unionByName(two.select("prev", "word", "cnt"))


def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, read back as a raw frequency list."""
    path = _path(spark)
    writers.write_counts(word_counts(spark, sf_dir), path)
    return readers.read_raw_frequencies(spark, path).select("form", "lemma", "freq", "ok")


def artifact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    writers.write_history(h.history_counts(spark, sf_dir), path)
    return readers.read_history(spark, path)


def artifact_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's expansions keep their order, which is that of the lines."""
    path = _path(spark)
    lines = writers.tab_lines(r.shortcut_table(base_lexicon(spark, sf_dir)).orderBy("key", "ord"), "key", "form", "lemma")
    lines.write.text(path)
    return readers.read_shortcuts(spark, [path], P).select("key", F.col("ord").cast("bigint").alias("ord"), "form", "lemma")


def artifact_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    cases = r.context_queries(spark, sf_dir).select(
        "input", F.element_at(F.split("query_id", " "), -1).alias("expected"), F.lit("passage").alias("tag"), "context"
    )
    writers.write_cases(cases, path)
    return readers.read_cases(spark, path, strict=True).select(
        "input", "expected", "tag", F.array_join("context", " ").alias("context")
    )


SQL = {
    "artifact_lexicon": o.with_(*o.lex())
    + "SELECT row_number() OVER (ORDER BY freq DESC, form) AS form_id, form, lemma, freq FROM lex",
    "artifact_ngrams": o.with_(*o.lex(), *c.LM_PARTS)
    + "SELECT '' AS prev, word, cnt FROM unigrams UNION ALL SELECT prev, word, cnt FROM bigrams",
    "artifact_counts": o.with_(o.counts("c", "documents"))
    + "SELECT word AS form, word AS lemma, cnt::DOUBLE AS freq, true AS ok FROM c",
    "artifact_history": f"SELECT * FROM ({h.SQL['history_counts']}) WHERE confirmed > 0 OR reverted > 0",
    "artifact_shortcuts": o.with_(*o.lex(), r._SHORTCUTS) + "SELECT key, ord, form, lemma FROM shortcuts",
    "artifact_cases": o.with_(*r._CONTEXT_QUERIES[:2])
    + "SELECT norm_input AS input, word AS expected, 'passage' AS tag, prev AS context FROM qs JOIN cq USING (prev) "
    "WHERE query_id = prev || ' ' || word",
}
RUN = {name: globals()[name] for name in SQL}
