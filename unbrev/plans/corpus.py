"""Counting jobs over raw text: tokens, n-grams and mined abbreviations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unbrev.functions import scoring as sc
from unbrev.functions import text as tx
from unbrev.operators.blocked import top_k
from unbrev.operators.lexicons import lexicon_block, lexicon_order, vocabulary, with_keys
from unbrev.profile import Profile


def token_counts(
    texts: DataFrame, profile: Profile, column: str = "text", min_count: int = 1
) -> DataFrame:
    """``(word, cnt)`` of every word in a text column.

    Words are counted as they are written first, so each spelling is normalised once.
    """
    one = f"[{profile.raw_letter_class}]+"
    found = F.regexp_extract_all(F.col(column), F.lit(f"{one}(?:-{one})*"), F.lit(0))
    return (
        texts.select(F.explode(found).alias("raw"))
        .groupBy("raw")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy(tx.normalize_stored(F.col("raw"), profile).alias("word"))
        .agg(F.sum("cnt").alias("cnt"))
        .filter(F.col("cnt") >= min_count)
    )


def text_lines(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.select(F.explode(F.split(F.col(column), "\n")).alias("line"))


def line_tokens(lines: DataFrame, profile: Profile) -> DataFrame:
    """The ``tokens`` of each line.

    They come out of an explode of one element: filters and expressions of later steps
    read them there, and do not each split the line again.
    """
    tokens = tx.corpus_tokens(F.col("line"), profile)
    return lines.select(F.explode(F.array(tokens)).alias("tokens"))


def unigram_counts(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, cnt)`` of the corpus tokens found in the vocabulary."""
    return (
        tokens.select(F.explode("tokens").alias("norm"))
        .groupBy("norm")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .join(vocab.select("norm"), "norm", "left_semi")
        .select(F.col("norm").alias("word"), "cnt")
    )


def adjacent_counts(tokens: DataFrame, min_count: int = 1) -> DataFrame:
    """``(prev, word, cnt)`` of adjacent tokens within a line.

    Pairs are formed inside the row and counted before anything is looked up,
    so only summed pairs are shuffled.
    """
    shifted = F.arrays_zip(
        F.col("tokens").alias("prev"),
        F.slice("tokens", F.lit(2), F.size("tokens")).alias("word"),
    )
    return (
        tokens.filter(F.size("tokens") > 1)
        .select(F.explode(shifted).alias("p"))
        .select(F.col("p.prev").alias("prev"), F.col("p.word").alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy("prev", "word")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt") >= min_count)
    )


def bigram_counts(
    tokens: DataFrame, vocab: DataFrame, min_count: int = 1
) -> DataFrame:
    """Adjacent pairs whose words are both in the vocabulary.

    A word outside the vocabulary breaks adjacency, which is the same as asking
    that both words of the raw pair are known.
    """
    known = vocab.select("norm")
    return (
        adjacent_counts(tokens, min_count)
        .join(known.withColumnRenamed("norm", "prev"), "prev", "left_semi")
        .join(known.withColumnRenamed("norm", "word"), "word", "left_semi")
        .select("prev", "word", "cnt")
    )


def build_bigrams(
    lines: DataFrame,
    lexicon: DataFrame,
    profile: Profile,
    top: int | None = None,
    min_count: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Unigram and bigram tables of a corpus with a ``line`` column.

    With ``top`` only that many of the most frequent pairs are kept.
    """
    vocab = vocabulary(lexicon, profile)
    tokens = line_tokens(lines, profile)
    unigrams = unigram_counts(tokens, vocab)
    pairs = bigram_counts(tokens, vocab, min_count)
    if top is None:
        return unigrams, pairs

    def side(name: str, prefix: str) -> DataFrame:
        return vocab.select(
            F.col("norm").alias(name),
            F.col("form_id").alias(f"{prefix}form_id"),
            F.col("freq").alias(f"{prefix}freq"),
        )

    placed = (
        pairs.join(side("prev", "p_"), "prev")
        .join(side("word", "w_"), "word")
        .withColumn("p_form", F.col("prev"))
        .withColumn("w_form", F.col("word"))
    )
    best = top_k(
        placed,
        top,
        "cnt",
        lexicon_block("p_"),
        [*lexicon_order("p_"), *lexicon_order("w_")],
    )
    return unigrams, best.select("prev", "word", "cnt")


def pmi_table(unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """``(prev, word, pmi)`` for every counted pair, ready to be looked up."""
    one = unigrams.groupBy("word").agg(F.sum("cnt").alias("n"))
    total = one.agg(F.sum("n")).scalar()
    pairs = bigrams.groupBy("prev", "word").agg(F.sum("cnt").alias("cnt"))
    prev = one.select(F.col("word").alias("prev"), F.col("n").alias("n_prev"))
    word = one.select("word", F.col("n").alias("n_word"))
    return (
        pairs.join(prev, "prev")
        .join(word, "word")
        .select(
            "prev",
            "word",
            sc.positive_pmi(
                F.col("cnt"), total, F.col("n_prev"), F.col("n_word")
            ).alias("pmi"),
        )
    )


def best_word_per_skeleton(lexicon: DataFrame, profile: Profile) -> DataFrame:
    """``(skel, word, freq)``: most frequent form of each non-empty skeleton.

    Equal frequencies go to the form that loads first.
    """
    first = F.min(F.struct((-F.col("freq")).alias("neg"), "form_id", "norm"))
    return (
        with_keys(lexicon, profile)
        .filter(F.col("skel") != "")
        .groupBy("skel")
        .agg(first.alias("b"))
        .select("skel", F.col("b.norm").alias("word"), (-F.col("b.neg")).alias("freq"))
    )


def mine_pairs(
    counts: DataFrame, lexicon: DataFrame, profile: Profile, min_count: int = 2
) -> DataFrame:
    """``(token, word, cnt)``: corpus tokens that shorten a lexicon word.

    A token qualifies when it is not in the lexicon and the most frequent word
    with its skeleton is longer than it is.
    """
    known = with_keys(lexicon, profile).select(F.col("norm").alias("word"))
    unknown = (
        counts.filter((F.col("cnt") >= min_count) & (F.length("word") >= 2))
        .join(known, "word", "left_anti")
        .select(
            F.col("word").alias("token"),
            "cnt",
            tx.skeleton(F.col("word"), profile).alias("skel"),
        )
        .filter(F.col("skel") != "")
    )
    return (
        unknown.join(best_word_per_skeleton(lexicon, profile), "skel")
        .filter(F.length("token") < F.length("word"))
        .select("token", "word", "cnt")
    )


def shard_texts(posts: DataFrame) -> DataFrame:
    """Text blobs of post/comment shards: the post, then each comment's text."""
    comments = F.coalesce(
        F.when(F.size("comments.text_html") > 0, F.col("comments.text_html")),
        F.col("comments.text_markdown"),
    )
    body = posts.select(F.col("text_markdown").alias("text"))
    replies = posts.select(F.explode(comments).alias("html")).select(
        tx.strip_tags(F.col("html")).alias("text")
    )
    return body.unionByName(replies).filter(F.col("text").isNotNull())
