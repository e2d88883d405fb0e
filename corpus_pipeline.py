"""The corpus pipeline: stages over ``documents``, each by one operator.

Every stage reads what the one before wrote as Parquet, works on all of it, and hands
on the columns of ``documents``; the last one returns encodings.

Stages look at ``doc_id``, ``text``, ``source``, ``lang`` and, where they change a text, at
``n_chars``.  Every other column passes through unchanged, whatever its name.  Null and
empty texts count alike, texts of any length are worked on whole, repeated rows are judged
one by one or as one document (see the stages), and an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unbrev.llm import byte_bpe, language, mixing, near_text, repeats
from unbrev.llm.common import crc_remainder, packed, small_batches, unpacked
from unbrev.llm.queries import BPE_PATTERN, BPE_RANKS, PIECES
from unbrev.session import shared_folder

#: Least score of a language that a document is kept for.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, or in no language that the model is sure of.

    The model learns from the documents themselves, but those held out and those without a
    ``lang``; a row with a null id is not held out.  Rows are judged one by one by their
    text alone: a null or empty text goes, rows that repeat a text share its fate, a tie
    goes to the first language by name.
    """
    small_batches(spark)
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = language.fit(language.training_rows(docs, held_out), PIECES)
    sure = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)
    judged = language.predict(packed(docs, "text"), model).filter(sure)
    return unpacked(judged, docs.columns, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: that with the smallest id.

    Near are texts whose sets of five-word shingles, the width for stages of a pipeline,
    are similar to 0.8 or more.  Rows that repeat an id count as one document and share
    its fate.  Null ids, null texts and texts without words are near to nothing and stay.
    """
    small_batches(spark)
    groups = near_text.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return unpacked(packed(docs, "doc_id").join(gone, "doc_id", "left_anti"), docs.columns, "doc_id")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out bytes that documents with smaller ids have too, in runs of 50 or more.

    Documents of which nothing is left go.  Rows of one id take nothing from each other;
    rows with a null id, null or short texts stay as they are.
    """
    small_batches(spark)
    return repeats.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics get their weights.

    Null sources and languages are a value of their own.  The draw is a hash of the id:
    rows that repeat an id in one cell share their fate, null ids share one draw.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row, encoded and decoded; null texts as empty.

    Returns ``doc_id, source, lang`` with them; other columns end here.
    """
    small_batches(spark)
    return byte_bpe.digests(docs.select("doc_id", "source", "lang", "text"), BPE_RANKS, BPE_PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Trained models, components and token ids are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages, in order, to the documents table."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}")
    return docs
