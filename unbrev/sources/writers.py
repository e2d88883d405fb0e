"""Writers: parquet tables for further jobs, sorted text for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unbrev.profile import CASES


def plain_number(c: Column) -> Column:
    """Whole numbers without a trailing ``.0``."""
    whole = c == F.floor(c)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def tab_lines(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def sorted_lexicon(lexicon: DataFrame) -> DataFrame:
    """Frequency falling, then form; a range-partitioned sort."""
    return lexicon.orderBy(F.desc("freq"), "form")


def write_lexicon(lexicon: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted text, one part file per range of the order."""
    lines = tab_lines(
        sorted_lexicon(lexicon),
        "form",
        "lemma",
        plain_number(F.col("freq")),
        F.when(F.col("tags") != "", F.col("tags")),
    )
    lines.write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_ngrams(
    unigrams: DataFrame, bigrams: DataFrame, path: str, mode: str = "error"
) -> None:
    """Text records ``u word count`` and ``b prev word count``."""
    one = tab_lines(unigrams, F.lit("u"), "word", F.col("cnt").cast("string"))
    two = tab_lines(
        bigrams.orderBy(F.desc("cnt"), "prev", "word"),
        F.lit("b"), "prev", "word", F.col("cnt").cast("string"),
    )
    one.unionByName(two).write.mode(mode).text(path)


def write_history(history: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted text, one folder per user; pairs without evidence are left out."""
    kept = history.filter((F.col("confirmed") > 0) | (F.col("reverted") > 0))
    value = F.concat_ws("\t", "skeleton", "form", F.col("confirmed").cast("string"), F.col("reverted").cast("string"))
    lines = kept.select("user_id", value.alias("value"))
    lines.orderBy("user_id", "value").write.mode(mode).partitionBy("user_id").text(path)


def write_paradigms(wide: DataFrame, path: str, mode: str = "error") -> None:
    """``lemma, group, six forms joined by |`` from the wide paradigm table."""
    lines = tab_lines(wide, "lemma", "grp", F.concat_ws("|", *CASES))
    lines.orderBy("value").write.mode(mode).text(path)


def write_counts(counts: DataFrame, path: str, mode: str = "error") -> None:
    """``word, count`` text, most frequent first."""
    ordered = counts.orderBy(F.desc("cnt"), "word")
    tab_lines(ordered, "word", F.col("cnt").cast("string")).write.mode(mode).text(path)


def write_pairs(pairs: DataFrame, path: str, mode: str = "error") -> None:
    """``token, word, count`` text in falling order of count, token and word."""
    ordered = pairs.orderBy(F.desc("cnt"), F.desc("token"), F.desc("word"))
    tab_lines(ordered, "token", "word", F.col("cnt").cast("string")).write.mode(mode).text(path)


def write_frequency_table(dictionary: DataFrame, path: str, mode: str = "error") -> None:
    """``lemma, ipm, pos`` text, most frequent first."""
    ordered = dictionary.orderBy(F.desc("ipm"), "lemma", "pos")
    tab_lines(ordered, "lemma", plain_number(F.col("ipm")), "pos").write.mode(mode).text(path)


def write_cases(cases: DataFrame, path: str, mode: str = "error") -> None:
    """``input, expected, tag[, context]`` text."""
    context = F.array_join("context", " ")
    tab_lines(
        cases, "input", "expected", "tag", F.when(context != "", context)
    ).write.mode(mode).text(path)


def write_misses(missed: DataFrame, path: str, mode: str = "error") -> None:
    tab_lines(missed, "input", "expected", "tag", "got").write.mode(mode).text(path)


def write_snapshot(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted parquet, so that two snapshots compare file by file."""
    lines.orderBy("input", "context", "ranked").write.mode(mode).parquet(path)
