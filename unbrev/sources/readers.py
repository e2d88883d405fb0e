"""Readers of the text artifacts.

Lines are read with ``spark.read.text`` and split on tabs; quotes mean nothing.
Strict readers check their rows with one aggregate and raise
:class:`BadRows` with the first bad line before the table is used; lenient ones
drop bad rows, and :func:`rejected` counts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unbrev.functions import text as tx
from unbrev.operators.lexicons import LEXICON_COLUMNS
from unbrev.plans.lexicon import append_lexicon
from unbrev.profile import Profile

# Numbers as the artifacts write them; casts alone would also
# take suffixed literals such as 1.5f.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
COUNT = r"^\+?\d+$"
GROUPS = ("sing", "plur", "sing.masc", "sing.femn", "sing.neut")

LOG_SCHEMA = (
    "ts BIGINT, status STRING, shorthand STRING, form STRING, context STRING, "
    "rank INT, fromHold BOOLEAN, user_id STRING"
)
SHARD_SCHEMA = (
    "text_markdown STRING, "
    "comments STRUCT<text_html: ARRAY<STRING>, text_markdown: ARRAY<STRING>>"
)


class BadRows(ValueError):
    """A strict artifact has rows that do not fit its format."""


# Lines of one split of a file at most, as a power of two.
_LINE_BITS = 33


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_id, raw)``; ``line_id`` grows along the files in the order of their
    names, with gaps.

    The planner packs splits of files by size, so the splits are numbered by file and
    offset, and lines within their split.  A ``user_id`` folder level is kept as a
    column.
    """
    lines = spark.read.text(path)
    users = [c for c in lines.columns if c == "user_id"]
    placed = lines.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LINE_BITS) - 1)).alias("_line"),
        F.col("value").alias("raw"),
        *users,
    )
    # One row per split of a file.
    splits = placed.select("_file", "_offset").distinct()
    nth = F.row_number().over(Window.orderBy("_file", "_offset")).cast("bigint") - 1
    return placed.join(splits.withColumn("_nth", nth), ["_file", "_offset"]).select(
        (F.col("_nth") * (1 << _LINE_BITS) + F.col("_line") + 1).alias("line_id"), "raw", *users
    )


def data_lines(lines: DataFrame, trim: Column | None = None) -> DataFrame:
    """Drop blank and ``#`` lines; adds the trimmed ``line`` and its ``cols``."""
    line = tx.strip(F.col("raw")) if trim is None else trim
    return (
        lines.withColumn("line", line)
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .withColumn("cols", F.split("line", "\t", -1))
    )


def col_at(i: int) -> Column:
    """Column ``i`` (from 0) of a split line, null past the end."""
    return F.get("cols", F.lit(i))


def require(lines: DataFrame, good: Column, what: str) -> None:
    """Raise :class:`BadRows` unless every row is good (one small aggregate)."""
    bad = ~F.coalesce(good, F.lit(False))
    seen = lines.agg(
        F.count_if(bad).alias("n"),
        F.min_by(F.when(bad, F.col("raw")), F.when(bad, F.col("line_id"))).alias("raw"),
        F.min(F.when(bad, F.col("line_id"))).alias("at"),
    ).first()
    if seen["n"]:
        raise BadRows(f"{what}: {seen['n']} bad rows, first at {seen['at']}: {seen['raw']!r}")


def rejected(lines: DataFrame, good: Column) -> DataFrame:
    """One row ``(kept, skipped)`` for a lenient reader's condition."""
    ok = F.coalesce(good, F.lit(False))
    return lines.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def read_lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """Strict ``form, lemma, freq[, tags]`` lines; several files are appended
    in the order given, homographs kept."""

    def one(path: str) -> DataFrame:
        lines = data_lines(numbered_lines(spark, path))
        freq = tx.strip(col_at(2))
        good = F.size("cols").between(3, 4) & is_number(freq)
        require(lines, good, path)
        return lines.select(
            F.col("line_id").alias("form_id"),
            tx.strip(col_at(0)).alias("form"),
            tx.strip(col_at(1)).alias("lemma"),
            freq.cast("float").cast("double").alias("freq"),
            F.coalesce(tx.strip(col_at(3)), F.lit("")).alias("tags"),
        )

    return append_lexicon(*[one(p) for p in paths])


def read_ngrams(
    spark: SparkSession, path: str, profile: Profile
) -> tuple[DataFrame, DataFrame]:
    """Unigrams ``(word, cnt)`` and bigrams ``(prev, word, cnt)``; repeated
    records are summed."""
    lines = data_lines(numbered_lines(spark, path))
    kind, size = col_at(0), F.size("cols")
    good = ((kind == "u") & (size == 3) & col_at(2).rlike(COUNT)) | (
        (kind == "b") & (size == 4) & col_at(3).rlike(COUNT)
    )
    require(lines, good, path)
    first, second = (tx.normalize(col_at(i), profile) for i in (1, 2))
    unigrams = (
        lines.filter(kind == "u")
        .groupBy(first.alias("word"))
        .agg(F.sum(col_at(2).cast("bigint")).alias("cnt"))
    )
    bigrams = (
        lines.filter(kind == "b")
        .groupBy(first.alias("prev"), second.alias("word"))
        .agg(F.sum(col_at(3).cast("bigint")).alias("cnt"))
    )
    return unigrams, bigrams


def read_shortcuts(spark: SparkSession, paths: Sequence[str], profile: Profile) -> DataFrame:
    """``(key, ord, form, lemma)`` of one or more files; a key's expansions
    stack in file and line order."""
    parts = []
    for at, path in enumerate(paths):
        lines = data_lines(numbered_lines(spark, path))
        require(lines, F.size("cols").between(2, 3), path)
        parts.append(
            lines.select(
                tx.normalize(tx.strip(col_at(0)), profile).alias("key"),
                F.struct(
                    F.lit(at).alias("file"),
                    "line_id",
                    tx.strip(col_at(1)).alias("form"),
                    tx.strip(F.coalesce(col_at(2), col_at(1))).alias("lemma"),
                ).alias("e"),
            )
        )
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    place = F.row_number().over(Window.partitionBy("key").orderBy("e.file", "e.line_id"))
    return every.select("key", place.alias("ord"), "e.form", "e.lemma")


def read_mask_list(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """One lemma per line, one token per lemma."""
    lines = data_lines(numbered_lines(spark, path))
    require(lines, ~F.col("line").rlike(r"(?U)\s"), path)
    return lines.select(tx.normalize(F.col("line"), profile).alias("lemma")).distinct()


def read_tone_markers(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """``(word, sign)``; signs are numbers in [-1, 1] or ``+``/``-``; the last
    line of a word wins."""
    lines = data_lines(numbered_lines(spark, path))
    raw = tx.strip(col_at(1))
    sign = (
        F.when(raw == "+", F.lit(1.0))
        .when(raw == "-", F.lit(-1.0))
        .when(is_number(raw), raw.try_cast("float").cast("double"))
    )
    require(lines, sign.between(-1.0, 1.0), path)
    return lines.groupBy(tx.normalize(tx.strip(col_at(0)), profile).alias("word")).agg(
        F.max_by(sign, F.col("line_id")).alias("sign")
    )


def paradigm_lines(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """Raw lines of a paradigm file and the condition a good row meets."""
    end = F.regexp_replace("raw", r"(?U)\s+$", "")
    lines = data_lines(numbered_lines(spark, path), end).withColumn(
        "cells", F.split(col_at(2), r"\|", -1)
    )
    filled = F.exists("cells", lambda c: c != "")
    good = (
        (F.size("cols") == 3)
        & col_at(1).isin(*GROUPS)
        & (F.size("cells") == 6)
        & filled
    )
    return lines, good


def read_paradigms(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """Long table ``(lemma, number, gender, case_ord, form)``; bad rows are
    dropped and empty cells left out."""
    lines, good = paradigm_lines(spark, path)
    group = F.split(col_at(1), r"\.")
    return (
        lines.filter(good)
        .select(
            tx.normalize(col_at(0), profile).alias("lemma"),
            F.get(group, F.lit(0)).alias("number"),
            F.get(group, F.lit(1)).alias("gender"),
            F.posexplode("cells").alias("p", "form"),
        )
        .filter(F.col("form") != "")
        .select("lemma", "number", "gender", (F.col("p") + 1).alias("case_ord"), "form")
    )


def read_history(spark: SparkSession, path: str, user_id: str = "") -> DataFrame:
    """``skeleton, form, confirmed[, reverted]`` lines; bad rows are dropped,
    a missing reverted count is 0, repeated pairs are summed.

    A folder with one level per user, as :func:`write_history` makes it, has the
    users in it; for a plain file ``user_id`` names the user.
    """
    lines = numbered_lines(spark, path).withColumn("cols", F.split("raw", "\t", -1))
    if "user_id" not in lines.columns:
        lines = lines.withColumn("user_id", F.lit(user_id))

    def count(i: int) -> Column:
        text = tx.strip(col_at(i))
        return F.when(text.rlike(COUNT), text.try_cast("bigint"))

    return (
        lines.filter((F.size("cols") >= 3) & count(2).isNotNull())
        .groupBy(
            F.col("user_id").cast("string").alias("user_id"),
            col_at(0).alias("skeleton"),
            col_at(1).alias("form"),
        )
        .agg(
            F.sum(count(2)).alias("confirmed"),
            F.sum(F.coalesce(count(3), F.lit(0))).alias("reverted"),
        )
        .select("user_id", "skeleton", "form", "confirmed", "reverted")
    )


def read_cases(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``input, expected[, tag[, context]]`` lines."""
    lines = data_lines(numbered_lines(spark, path))
    good = F.size("cols") >= 2
    if strict:
        require(lines, good, path)
    words = F.filter(
        F.split(F.coalesce(col_at(3), F.lit("")), r"(?U)\s+"), lambda w: w != ""
    )
    return lines.filter(good).select(
        F.col("line_id").alias("case_id"),
        col_at(0).alias("input"),
        col_at(1).alias("expected"),
        F.coalesce(col_at(2), F.lit("untagged")).alias("tag"),
        words.alias("context"),
    )


def read_raw_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``(line_id, form, lemma, freq, ok)`` of two- or three-field lines split
    on tab, semicolon, comma or space; bad lines have ``ok`` false."""
    fields = F.filter(F.split("line", r"[\t;, ]"), lambda f: tx.strip(f) != "")
    lines = data_lines(numbered_lines(spark, path)).withColumn(
        "f", F.transform(fields, tx.strip)
    )
    size = F.size("f")
    number = F.get("f", size - 1)
    ok = size.between(2, 3) & is_number(number)
    return lines.select(
        "line_id",
        F.get("f", F.lit(0)).alias("form"),
        F.get("f", size - 2).alias("lemma"),
        F.when(ok, number.try_cast("float").cast("double")).alias("freq"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def read_corpus_dictionary(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """``(lemma, ipm, pos)`` of a frequency dictionary with a header line."""
    lines = numbered_lines(spark, path).withColumn("cols", F.split("raw", "\t", -1))
    number = tx.strip(col_at(2))
    return lines.filter(
        (F.size("cols") >= 3) & is_number(number) & tx.is_lexicon_word(col_at(0), profile)
    ).select(
        col_at(0).alias("lemma"), number.cast("double").alias("ipm"), col_at(1).alias("pos")
    )


def read_frequency_table(spark: SparkSession, path: str) -> DataFrame:
    """The written form of the dictionary: ``lemma, ipm, pos`` with comments."""
    lines = data_lines(numbered_lines(spark, path))
    number = tx.strip(col_at(1))
    return lines.filter((F.size("cols") >= 3) & is_number(number)).select(
        col_at(0).alias("lemma"), number.cast("double").alias("ipm"), tx.strip(col_at(2)).alias("pos")
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(line)`` rows; broken bytes are replaced, never fatal."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Posts with comments; broken lines become empty rows, which yield no
    text, and a cut-off compressed file keeps what could be read."""
    return (
        spark.read.schema(SHARD_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("ignoreCorruptFiles", "true")
        .json(path)
    )


def read_names(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(name, kind)``; plain or gzipped text, one name per line."""
    lines = data_lines(numbered_lines(spark, path))
    require(lines, ~F.col("raw").contains("\u0000"), path)
    return lines.select(F.col("line").alias("name"), F.lit(kind).alias("kind"))


def _log_rows(lines: DataFrame) -> DataFrame:
    """The log writes milliseconds; everything after it takes timestamps."""
    return lines.withColumn("ts", F.timestamp_millis("ts"))


def read_acceptance_log(spark: SparkSession, path: str) -> DataFrame:
    return _log_rows(spark.read.schema(LOG_SCHEMA).json(path))


def stream_acceptance_log(spark: SparkSession, path: str) -> DataFrame:
    return _log_rows(spark.readStream.schema(LOG_SCHEMA).json(path))


def read_lexicon_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*LEXICON_COLUMNS)
