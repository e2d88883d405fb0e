"""Quality rules: hashed n-gram log-likelihood ratio of a trusted set to the corpus.

Words and word pairs are hashed to ``BUCKETS`` features.  Two multinomials over the
features, of the trusted texts and of the whole corpus, give each feature a log ratio;
a document's score is the mean over its features, so that length does not matter, and
a fixed threshold decides.  Plain counting rules come first.  Everything is built-in
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unbrev.llm.common import SEPARATOR_CLASS
from unbrev.llm.url_filter import bloom_filter, possible_hits

#: Features; the table of ratios is 128 kB whatever the corpus.
BUCKETS = 1 << 14
#: Added to every feature's count in both multinomials.
SMOOTHING = 1.0
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.15
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

_GAPS = " \t\n\x0b\f\r"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order; everything else is made from these."""
    trimmed = F.btrim(text, F.lit(_GAPS))
    words = F.when(trimmed != "", F.split(trimmed, SEPARATOR_CLASS + "+"))
    none = F.array().cast("array<bigint>")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), none)


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pair(hashes: Column, h: Column, i: Column) -> Column:
    """Feature of a word and the next one; null for the last word."""
    following = F.get(hashes, i + 1)
    return F.when(following.isNotNull(), _bucket(F.xxhash64(h, following)))


def features(hashes: Column) -> Column:
    """Feature numbers of all words and all pairs of neighbouring words."""
    pairs = F.transform(hashes, lambda h, i: _pair(hashes, h, i))
    return F.concat(F.transform(hashes, _bucket), F.array_compact(pairs))


def mean_ratio(hashes: Column, ratios: Column) -> Column:
    """Mean log ratio of the features of a text; null without words."""

    def both(h: Column, i: Column) -> Column:
        return F.get(ratios, _bucket(h)) + F.coalesce(F.get(ratios, _pair(hashes, h, i)), F.lit(0.0))

    total = F.aggregate(F.transform(hashes, both), F.lit(0.0), lambda a, x: a + x)
    return total / F.nullif(2 * F.size(hashes) - 1, F.lit(-1))


def repeated_words(hashes: Column) -> Column:
    """Number of words in ``WINDOW``-word windows that occur twice or more."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(
        starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])
    )

    def places(ordered: Column) -> Column:
        def marked(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ordered, i - 1)["h"])
            after = F.get(ordered, i + 1)["h"]
            return F.when(before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"]), x["at"])

        return F.array_sort(F.array_compact(F.transform(ordered, marked)))

    def covered(at: Column) -> Column:
        room = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, room), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(all_windows: Column) -> Column:
        none = F.size(F.array_distinct(all_windows)) == F.size(all_windows)
        placed = F.transform(all_windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(none, F.lit(0).cast("bigint")).otherwise(
            let(F.array_sort(placed), lambda o: let(places(o), covered))
        )

    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(windows, count))


def feature_counts(texts: DataFrame, name: str) -> DataFrame:
    """``(feature, name)``: at most ``BUCKETS`` rows, summed up in the map tasks."""
    numbers = let(word_hashes(F.col("text")), features)
    return (
        texts.select(F.explode(numbers).alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias(name))
    )


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with ``ratios array<double>``, by feature.

    ``docs (doc_id, text)`` is the corpus; ``trusted (doc_id)`` names its trusted
    documents, repeats allowed.  Without trusted documents all ratios are 0.
    """
    names = trusted.select("doc_id").filter("doc_id is not null").distinct()
    key = F.col("doc_id").cast("string")
    bloom = bloom_filter(names.select(key.alias("k")), "k")
    maybe = possible_hits(docs.select("doc_id", "text").withColumn("_k", key), bloom, "_k")
    target = feature_counts(maybe.join(names.hint("merge"), "doc_id", "left_semi"), "target")
    raw = feature_counts(docs, "raw")
    every = docs.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("feature"))
    both = (
        every.join(raw, "feature", "left")
        .join(target, "feature", "left")
        .fillna(0, ["raw", "target"])
        .agg(F.sort_array(F.collect_list(F.struct("feature", "target", "raw"))).alias("c"))
        .select(
            "c",
            F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["target"]).alias("target"),
            F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["raw"]).alias("raw"),
        )
    )

    def log_share(n: str):
        return lambda x: F.log((x[n] + SMOOTHING) / (F.col(n) + SMOOTHING * BUCKETS))

    ratio = F.transform("c", lambda x: log_share("target")(x) - log_share("raw")(x))
    none = F.transform("c", lambda x: F.lit(0.0))
    return both.select(F.when(F.col("target") > 0, ratio).otherwise(none).alias("ratios"))


def judge_quality(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept`` of every row.

    Null and empty texts have no words, fail the base rules and have score 0.
    Repeated rows are judged one by one; each counts in the corpus.  A document is
    kept if the base rules pass and its score is the threshold at least (a tie
    stays).  Other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most BUCKETS numbers, as one constant of the plan.
    (found,) = log_ratios(docs, trusted).first()
    ratios = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _GAPS, "") != "")
    # One value per text holds what depends on its words.
    counted = let(
        word_hashes(F.col("text")),
        lambda h: F.struct(
            F.size(h).cast("bigint").alias("n_words"),
            repeated_words(h).alias("n_repeat_words"),
            mean_ratio(h, ratios).alias("score"),
        ),
    )
    measured = docs.select(
        "doc_id",
        counted.alias("_words"),
        F.length(F.translate("text", _GAPS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ).select("*", "_words.*")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    score = F.coalesce("score", F.lit(0.0))
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        score.alias("score"),
        (~failed & (score >= threshold)).alias("kept"),
    )
